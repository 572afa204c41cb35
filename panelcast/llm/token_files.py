"""Token-id files compressed by Re-Pair, one grammar per shard.

Documents are range-partitioned by id, encoded, and cut into shards of consecutive documents. In
each shard the frequent neighbour pairs become new symbols, round after round, until a round
saves too little; a pair never spans two documents. A shard row holds the document table, the
rules, the length each rule expands to and the compressed sequence, so that one document can be
decoded without the rest (`read_document`). The rows are written as Parquet, whose commit
protocol survives lost executors; the sections are the file format below.

Section formats, little-endian: `ids` int64 document ids with `has_id` flags; `sizes` uint32
tokens and `symbols` uint32 compressed symbols per document; `rules` uint32 pairs (rule k makes
symbol BASE + k); `expansions` uint32 per rule; `sequence` the symbols in three bytes each.
"""
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from panelcast.llm import wordcodes as C, words as W

BASE = 1 << 20  # first symbol of a rule; vocabularies are smaller
END = 1
SLOTS = 18
SHARD = "part int, seq int, n_docs int, n_ids bigint, before bigint, ids binary, has_id binary, sizes binary, symbols binary, rules binary, expansions binary, sequence binary"
_held = {}


class TextEncoder:
    """Encodes texts with a tokenizers file whose normalizer composes, lower-cases and drops white space.

    Plain texts are split into words with numpy, and the library encodes each word it hasn't seen lately once. A
    text with special tokens or letters beyond U+0500 is encoded by the library as a whole.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = C.WordIds(self.learn)

    def learn(self, data, start, length):
        raw = data.tobytes()
        words = [raw[a:a + n].decode() for a, n in zip(start.tolist(), length.tolist())]
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    @staticmethod
    def normal(text):
        # the library lower-cases letter by letter, so the sigma at a word's end isn't special
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower().encode()

    def encode(self, texts):
        """Ids of all texts, END after each, and the tokens of each text with its END."""
        whole = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        own = set(whole)
        raw = [b"" if k in own else self.normal(t) for k, t in enumerate(texts)]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
        data = np.frombuffer(b"".join(raw), np.uint8)
        odd = np.flatnonzero(~C.plain_rows(data, offsets)).tolist()
        if odd:
            whole += odd
            for k in odd:
                raw[k] = b""
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
            data = np.frombuffer(b"".join(raw), np.uint8)
        begin, end, first = C.split_words(data, offsets, False)
        if len(begin):
            ids, borders = self.words.ids(data, begin, end)
            borders = borders[first]
        else:
            ids, borders = np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if whole:
            parts = np.split(ids, borders[1:-1])
            for k, x in zip(whole, self.tokenizer.encode_batch([texts[k] for k in whole], add_special_tokens=False)):
                parts[k] = np.array(x.ids, np.int32)
            ids, borders = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return np.insert(ids, borders[1:], END).astype(np.uint32), np.diff(borders) + 1


def compress(ids, sizes, pairs=2048, least=8, gain=0.02):
    """Re-Pair: (rules, expansions, sequence, symbols per document).

    Each round counts the neighbour pairs of the whole shard, makes rules of the most frequent
    ones (at most `pairs`, each at least `least` times), and replaces, where chosen pairs overlap, the
    more frequent. It ends when a round saves less than `gain` of the sequence.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes) - 1] = True
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)

    def length(symbols):
        out = np.ones(len(symbols), np.uint32)
        rule = symbols >= BASE
        out[rule] = lengths[symbols[rule] - BASE]
        return out

    turn = 0x9E3779B1
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        turn = turn * 0x85EBCA77 & 0xFFFFFFFF  # other pairs share slots in each round
        slot = ((a * np.uint32(turn) ^ b * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - SLOTS)).astype(np.int64)
        slot[last[:-1]] = 1 << SLOTS
        counts = np.bincount(slot, minlength=(1 << SLOTS) + 1)
        counts[-1] = 0
        floor = max(least, int(np.partition(counts, -pairs)[-pairs]))
        at = np.flatnonzero(counts[slot] >= floor)
        if not len(at):
            break
        # of pairs that share a slot one goes first, the others in a later round
        own = slot[at]
        first = np.zeros(len(counts), np.int64)
        first[own] = at
        same = (a[at] == a[first[own]]) & (b[at] == b[first[own]])
        at, own = at[same], own[same]
        n = np.bincount(own, minlength=len(counts))
        chosen = np.flatnonzero(n >= least)
        chosen = chosen[np.argsort(-n[chosen], kind="stable")][:pairs]
        if not len(chosen):
            break
        place = np.full(len(counts), pairs, np.int32)
        place[chosen] = np.arange(len(chosen))
        rank = np.full(len(seq) + 1, pairs, np.int32)  # rank[i + 1]: of the pair at i
        rank[at + 1] = place[own]
        here = np.flatnonzero(rank < pairs)
        # of overlapping pairs the lower rank stays; of equal ones in a row every second
        new_run = np.ones(len(here), bool)
        new_run[1:] = (here[1:] != here[:-1] + 1) | (rank[here[1:]] != rank[here[:-1]])
        start = here[new_run]
        odd = (here - np.repeat(start, np.diff(np.append(np.flatnonzero(new_run), len(here))))) & 1
        right = np.append(rank, pairs)[here + 1]
        here = here[(odd == 0) & (rank[here - 1] >= rank[here]) & (right >= rank[here])]
        if len(here) > 1:  # two runs may still touch
            free = np.ones(len(here), bool)
            free[1:] = here[1:] != here[:-1] + 1
            here = here[free]
        if len(here) < max(1, gain * len(seq)):
            break
        symbol, at = rank[here], here - 1
        used, symbol = np.unique(symbol, return_inverse=True)
        left, right = seq[at], seq[at + 1]
        new = np.zeros((len(used), 2), np.uint32)
        new[symbol, 0], new[symbol, 1] = left, right
        added = length(new[:, 0]) + length(new[:, 1])
        seq[at] = BASE + len(rules) + symbol
        last[at] |= last[at + 1]
        rules, lengths = np.concatenate((rules, new)), np.concatenate((lengths, added))
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
    ends = np.flatnonzero(last) + 1
    return rules, lengths, seq, np.diff(np.concatenate(([0], ends)))


def pack(sequence):
    """Symbols below 2**24 as three little-endian bytes each; a shard has fewer rules than fit."""
    assert len(sequence) == 0 or int(sequence.max()) < 1 << 24
    return np.ascontiguousarray(sequence.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def unpack(data):
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def expand(sequence, rules):
    """Terminal ids of a sequence: each pass replaces the rules by their pairs."""
    while True:
        rule = sequence >= BASE
        if not rule.any():
            return sequence
        first = np.cumsum(1 + rule) - 1 - rule
        out = np.empty(int(first[-1]) + 1 + int(rule[-1]), np.uint32)
        out[first[~rule]] = sequence[~rule]
        pair = rules[sequence[rule] - BASE]
        out[first[rule]], out[first[rule] + 1] = pair[:, 0], pair[:, 1]
        sequence = out


def _shards(batches, path, limit):
    encoder = _held.get(path) or _held.setdefault(path, TextEncoder(path))
    part, seq = TaskContext.get().partitionId(), 0
    waiting, size, before = [], 0, 0

    def shard():
        nonlocal waiting, size, seq, before
        names = np.concatenate([x[0] for x in waiting])
        has = np.concatenate([x[1] for x in waiting])
        ids, sizes = np.concatenate([x[2] for x in waiting]), np.concatenate([x[3] for x in waiting])
        rules, lengths, sequence, symbols = compress(ids, sizes)
        row = [[part], [seq], [len(names)], [len(ids)], [before], names.astype("<i8").tobytes(), has.astype(np.uint8).tobytes(),
               sizes.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), rules.astype("<u4").tobytes(),
               lengths.astype("<u4").tobytes(), pack(sequence)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 7
        waiting, size, seq, before = [], 0, seq + 1, before + len(ids)
        return pa.RecordBatch.from_arrays([pa.array(v if isinstance(v, list) else [v], t) for v, t in zip(row, types)],
                                          names=[f.split()[0] for f in SHARD.split(", ")])

    for batch in batches:
        doc_id, texts = batch.column(0), batch.column(1)
        for low, high in W.pieces(W.column_bytes(texts)[1], 1 << 20):
            ids, sizes = encoder.encode(texts.slice(low, high - low).to_pylist())
            own = doc_id.slice(low, high - low)
            waiting.append((np.asarray(own.fill_null(0)).astype(np.int64), np.asarray(own.is_valid()), ids, sizes))
            size += len(ids)
            if size >= limit:
                yield shard()
    if waiting:
        yield shard()


def write(docs, path, folder, doc_id="doc_id", text="text", shard_ids=1 << 20):
    """Encode `docs` and write the shard table to `folder`, in ascending id order.

    Null ids come first, null texts are empty, rows with one id are ordered by their text. A shard
    closes after `shard_ids` ids; documents are never split.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(lambda b: _shards(b, path, shard_ids), SHARD).write.mode("overwrite").parquet(folder)


def _documents(batches, starts):
    for batch in batches:
        for row in batch.to_pylist():
            rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
            ids = expand(unpack(row["sequence"]), rules).astype("<u4")
            sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            ends = np.cumsum(sizes)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            names = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["has_id"], np.uint8) == 0)
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(starts[row["part"]] + row["before"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark, folder):
    """One row per document of a shard table: where its ids start among all, their number and checksum."""
    shards = spark.read.schema(SHARD).parquet(folder)
    # one number per writing task, as many as the write had partitions
    sizes = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    rows = shards.select("part", "before", "ids", "has_id", "sizes", "rules", "sequence")
    return rows.mapInArrow(lambda b: _documents(b, starts), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_document(row, k):
    """Ids of the k-th document of one shard row, decoding only its own symbols."""
    symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
    end = int(symbols[:k + 1].sum())
    sequence = unpack(row["sequence"][3 * (end - int(symbols[k])):3 * end])
    return expand(sequence, np.frombuffer(row["rules"], "<u4").reshape(-1, 2))
