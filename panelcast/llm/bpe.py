"""Byte-pair encoding with a minimal acyclic transducer for the frequent words.

The most frequent pre-tokens of the corpus (counted over all documents) are compiled into a
minimal automaton: words with a common rest share its states. Each arc carries how many words
come before the ones behind it, so the sum along a word's path is its number, and that number
leads to its token ids. The automaton is one block of bytes that each task maps into memory.
A word that it lacks is merged exactly, by merge rank. Decoding goes back from the ids through
the vocabulary's bytes.
"""
import hashlib
import heapq
import json
import mmap
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from panelcast.llm import wordcodes as C, words as W
from panelcast.llm.resampling import border
from panelcast.sources.files import store

#: Fixed value: the split of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters():
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = dict(zip(plain, map(chr, plain)))
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return letters


class Vocabulary:
    """Ids, merges and special tokens of a byte-level vocabulary file."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {letter: b for b, letter in byte_letters().items()}
        of = lambda token: bytes(back[c] for c in token)
        self.ids = {of(token): i for token, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(of(a), of(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        special = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pattern = regex.compile(SPLIT)

    def split(self, text):
        """Pre-tokens of a text; special tokens stand alone."""
        if self.cut and any(s in text for s in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def merge(self, word):
        """Token ids of one pre-token: join the pair of least rank, the leftmost of equals, until none is left."""
        parts = [word[i:i + 1] for i in range(len(word))]
        if len(parts) <= 48:  # short: a list of ranks is quicker than a heap
            get, none = self.ranks.get, len(self.ranks)
            ranks = [get(p, none) for p in zip(parts, parts[1:])]
            while ranks:
                least = min(ranks)
                if least == none:
                    break
                i = ranks.index(least)
                parts[i] += parts.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = get((parts[i - 1], parts[i]), none)
                if i < len(ranks):
                    ranks[i] = get((parts[i], parts[i + 1]), none)
            return [self.ids[p] for p in parts]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = [(self.ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (parts[a], parts[b]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[parts[a], parts[b]], a, (parts[a], parts[b])))
        return [self.ids[p] for p in parts if p is not None]


def compile_lexicon(words):
    """The automaton of a sorted list of distinct byte strings: (arc starts, labels, targets, outputs, finals).

    Words are added in order; once a word leaves the path of the one before, the part left
    behind is final and replaced by an equal state if there is one.
    """
    register, states = {}, []  # frozen states: (final, ((label, target), ...)) in order

    def freeze(node):
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path, last = [[False, {}]], b""
    for word in [*words, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        while len(path) > common + 1:
            done = freeze(path.pop())
            path[-1][1][last[len(path) - 1]] = done
        if word is None:
            break
        for b in word[common:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    root = freeze(path[0])
    counts, starts, labels, targets, outputs = [], [0], [], [], []
    for final, arcs in states:
        seen = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(seen)
            seen += counts[target]
        counts.append(seen)
        starts.append(len(labels))
    return root, np.array(starts, np.int32), np.array(labels, np.int32), np.array(targets, np.int32), np.array(outputs, np.int32), np.array([f for f, _ in states], np.int32)


class Lexicon:
    """Automaton and id lists in one memory-mapped block of 32-bit numbers."""

    @staticmethod
    def pack(words, ids_of):
        words = sorted(set(words))
        root, *tables = compile_lexicon(words)
        ids = [ids_of(w) for w in words]
        borders = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        tables += [borders, np.array([i for x in ids for i in x], np.int32)]
        head = np.array([root, *map(len, tables)], np.int32)
        return np.concatenate([head, *tables]).tobytes()

    def __init__(self, block):
        with tempfile.TemporaryFile() as f:  # has no name and ends with the map
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        numbers = np.frombuffer(self.map, np.int32)
        self.root, *sizes = numbers[:8].tolist()
        parts = np.split(numbers[8:], np.cumsum(sizes)[:-1])
        starts, labels, self.targets, self.outputs, self.finals, self.borders, self.ids = parts
        self.arcs = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * 256 + labels

    def numbers(self, data, start, length):
        """Number of each word data[start:start + length], -1 for those not in the lexicon; all take a step at a time."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.arcs):
            return out
        left, state, number = np.arange(len(start)), np.full(len(start), self.root), np.zeros(len(start), np.int64)
        step = 0
        while len(left):
            done = length[left] == step
            final = done & (self.finals[state] == 1)
            out[left[final]] = number[final]
            left, state, number = left[~done], state[~done], number[~done]
            key = state * 256 + data[start[left] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[arc] == key
            left, arc = left[ok], arc[ok]
            state, number, step = self.targets[arc].astype(np.int64), number[ok] + self.outputs[arc], step + 1
        return out

    def find(self, number):
        """Token ids of the words with these numbers, one after another, and how many each has."""
        start = self.borders[number].astype(np.int64)
        length = self.borders[number + 1] - start
        return C.gather(self.ids, start, length)[0], length


class Encoder:
    """Encodes text columns, the plain rows with numpy and the others text by text; keeps the ids of recent words."""

    def __init__(self, path, block):
        v = self.vocabulary = Vocabulary(path)
        self.lexicon = Lexicon(block)
        single = [v.ids[bytes([b])] for b in range(256)]
        self.merger = C.PairMerger(single, single, [(v.ids[a], v.ids[b], v.ids[a + b]) for a, b in v.ranks])
        self.words = C.WordIds(self.learn)
        size = max(v.bytes) + 1
        self.token_bytes = np.frombuffer(b"".join(v.bytes.get(i, b"") for i in range(size)), np.uint8)
        self.token_size = np.array([len(v.bytes.get(i, b"")) for i in range(size)])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.decimal = [str(i) for i in range(size)]

    def learn(self, data, start, length):
        number = self.lexicon.numbers(data, start, length)
        known = number >= 0
        sizes = np.zeros(len(start), np.int64)
        ids, sizes[known] = self.lexicon.find(number[known])
        more, sizes[~known] = self.merger.encode(data, start[~known], length[~known])
        out = np.empty(len(ids) + len(more), np.int32)
        own = np.repeat(known, sizes)
        out[own], out[~own] = ids, more
        return out, sizes

    def slow(self, text):
        v, out = self.vocabulary, []
        for word in v.split(text):
            if word in v.special:
                out.append(v.special[word])
            else:
                raw = np.frombuffer(word.encode(), np.uint8)
                out += self.learn(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0].tolist()
        return np.array(out, np.int32)

    def encode(self, column):
        """For consecutive rows of a text column: their ids, one after another, and the rows' borders."""
        special = [s.encode() for s in self.vocabulary.special]
        for _, data, offsets in W.text_pieces(column):
            raw = data.tobytes()
            plain = C.plain_rows(data, offsets)
            for s in special:
                at = raw.find(s)
                while at >= 0:
                    plain[np.searchsorted(offsets, at, "right") - 1] = False
                    at = raw.find(s, at + 1)
            odd = np.flatnonzero(~plain)
            texts = [data[offsets[k]:offsets[k + 1]].tobytes().decode() for k in odd]
            if len(odd):
                keep = np.repeat(plain, np.diff(offsets))
                data, offsets = data[keep], np.concatenate(([0], np.cumsum(np.diff(offsets) * plain)))
            begin, end, first = C.split_words(data, offsets, True)
            ids, borders = self.words.ids(data, begin, end) if len(begin) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
            borders = borders[first]
            if len(odd):
                parts = np.split(ids, borders[1:-1])
                for k, t in zip(odd, texts):
                    parts[k] = self.slow(t)
                ids, borders = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            yield ids, borders

    def decode(self, ids):
        """Bytes of the ids, one after another, and the borders of each id."""
        return C.gather(self.token_bytes, self.token_start[ids], self.token_size[ids])


def _count(batches, path, text, most=200_000):
    """(word, n): how often each pre-token stands in the texts of a task, in several rows where there are more than `most` words."""
    vocabulary = Vocabulary(path)
    counts = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for _, data, offsets in W.text_pieces(batch.column(batch.schema.get_field_index(text)), 1 << 19):
            plain = C.plain_rows(data, offsets)
            for k in np.flatnonzero(~plain):
                counts.update(w.encode() for w in vocabulary.split(data[offsets[k]:offsets[k + 1]].tobytes().decode()) if w not in vocabulary.special)
            if not plain.all():
                data, offsets = data[np.repeat(plain, np.diff(offsets))], np.concatenate(([0], np.cumsum(np.diff(offsets) * plain)))
            begin, end, _ = C.split_words(data, offsets, True)
            _, _, at, number = W.distinct_strings(data, begin, end)
            raw, n = data.tobytes(), np.bincount(number, minlength=len(at))
            for count, low, high in zip(n.tolist(), begin[at].tolist(), end[at].tolist()):
                counts[raw[low:high]] += count
            if len(counts) >= most:
                yield flush()
    if counts:
        yield flush()


def frequent_words(docs, path, text="text", size=50_000):
    """The most frequent pre-tokens of all documents, at most `size`; words that tie at the border are left out.

    The border is found by counting, so only the chosen words come to the driver.
    """
    counts = docs.select(text).mapInArrow(lambda b: _count(b, path, text), "word string, n long")
    counts = store(counts.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")
    least = border(counts, size + 1, "n")
    top = counts if least is None or counts.count() <= size else counts.filter(F.col("n") > least)
    return sorted(r.word for r in top.select("word").collect())


def _encode(batches, path, block, text, keep, with_ids):
    encoder = Encoder(path, block)  # lives as long as the task
    decimal = encoder.decimal
    for batch in batches:
        low = 0
        for ids, borders in encoder.encode(batch.column(batch.schema.get_field_index(text))):
            data, ends = encoder.decode(ids)
            data, places, numbers, rows = data.tobytes(), ends[borders].tolist(), ids.tolist(), borders.tolist()
            ids_sha, decoded_sha = [], []
            for k in range(len(rows) - 1):
                joined = ",".join([decimal[i] for i in numbers[rows[k]:rows[k + 1]]])
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(data[places[k]:places[k + 1]].decode("utf-8", "replace").encode()).hexdigest())
            part = batch.slice(low, len(rows) - 1)
            low += len(rows) - 1
            out = [part.column(part.schema.get_field_index(c)) for c in keep]
            out += [pa.array(np.diff(borders)), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                out.append(W.lists(ids, borders, pa.int32()))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)


def encode(docs, path, text="text", keep=("doc_id",), lexicon_size=50_000, with_ids=True):
    """Columns `keep` of each row, its token ids and the digests of the ids and of the text decoded from them.

    `path`: a byte-level vocabulary file that every machine has. Special tokens written out in a text are
    their ids. A null text is empty, an empty text has no ids; repeated rows are encoded each.
    Text columns other than `text` and columns with the names of the results aren't kept.
    """
    vocabulary = Vocabulary(path)
    words = [w for w in frequent_words(docs, path, text, lexicon_size) if w not in vocabulary.special]
    block = Lexicon.pack([w.encode() for w in words], vocabulary.merge)
    held = docs.sparkSession.sparkContext.broadcast(block)  # at most lexicon_size words
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    fields += ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(
        lambda b: _encode(b, path, held.value, text, list(keep), with_ids), ", ".join(fields))


def decode(encoded, path, ids="ids", out="text"):
    """The texts of a column of token ids."""
    def run(batches):
        known = Vocabulary(path).bytes
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [None if not x.is_valid else b"".join(known[i] for i in x.as_py()).decode("utf-8", "replace") for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    return encoded.mapInArrow(run, ", ".join([*fields, f"`{out}` string"]))
