"""Benchmark decontamination: an FM-index over each shard of the training text.

The shard's words are mapped to the numbers of the benchmark's vocabulary. A word outside it, or
a neighbour pair that no item has, cannot lie inside an occurrence, so the text is cut there and
cuts that are shorter than every phrase are dropped; what stays is the shard's indexed text.
Its suffix array gives the Burrows-Wheeler transform; the ranks come from a wavelet matrix.
All windows of one length are searched backwards at once, their places are found by walking to
sampled suffixes, and overlapping places merge into removal spans.

Items are held by every task, so their size is checked: over `block_words` words they are taken
in several blocks, one pass each over the text.
"""
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.names import free

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TABLE = W.byte_classes({*range(48, 58), *range(97, 123), *range(128, 256)})
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
HIT = "array<struct<item:{},first:int,last:int,start:int,stop:int>>"


def item_words(text):
    """The words of a text: A-Z lower-cased, then digits, a-z and everything outside ASCII."""
    return WORD.findall((text or "").translate(UPPER))


def suffix_array(symbols):
    """Suffix array by prefix doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([1], (key[1:] != key[:-1]).astype(np.int64)))
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n:
            return order
        step *= 2


class Wavelet:
    """Ranks of symbols in an integer sequence, one bit level after another."""

    def __init__(self, symbols, largest):
        self.bits = max(1, int(largest).bit_length())
        self.ranks, self.zeros = [], []
        for b in reversed(range(self.bits)):
            ones = (symbols >> b & 1).astype(bool)
            self.ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.int32))
            self.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol, place):
        """How often `symbol` stands before `place`; both are arrays."""
        low, high = np.zeros_like(place), place
        for b, ones, zeros in zip(reversed(range(self.bits)), self.ranks, self.zeros):
            up = (symbol >> b & 1).astype(bool)
            low = np.where(up, zeros + ones[low], low - ones[low])
            high = np.where(up, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    SAMPLE = 8

    def __init__(self, symbols, largest):
        """symbols: numbers from 1; a 0 is added as the end."""
        text = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=largest + 2))))
        self.tree = Wavelet(self.bwt, largest)
        sampled = order % self.SAMPLE == 0
        self.sampled, self.place = sampled, order[sampled]
        self.before = np.concatenate(([0], np.cumsum(sampled)))

    def search(self, phrases):
        """Suffix-array ranges of the rows of `phrases` (all of one length), last symbol first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for symbol in phrases.T[::-1]:
            low = self.less[symbol] + self.tree.rank(symbol, low)
            high = self.less[symbol] + self.tree.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows):
        """Text places of suffix-array rows: walk back to a sampled suffix, then add the steps."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled[rows]
            out[left[hit]] = self.place[self.before[rows[hit]]] + steps
            left, rows, steps = left[~hit], rows[~hit], steps + 1
            rows = self.less[self.bwt[rows]] + self.tree.rank(self.bwt[rows], rows)
        return out


class Phrases:
    """The windows of a block of items, as numbers of the block's vocabulary."""

    def __init__(self, items, size=10):
        self.items = sorted({item for item, _ in items})
        place, windows = {item: k for k, item in enumerate(self.items)}, {}
        for item, words in items:
            for i in range(max(1, len(words) - size + 1) if words else 0):
                windows.setdefault(tuple(words[i:i + size]), set()).add(place[item])
        vocabulary = sorted({w for window in windows for w in window})
        data = np.frombuffer("".join(vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in vocabulary], dtype=np.int64)
        hashes, checks = W.lane_hashes(data, np.concatenate(([0], ends[:-1])).astype(np.int64), ends, True)
        self.order = np.argsort(hashes)
        self.hashes, self.checks, number = hashes[self.order], checks[self.order], np.empty(len(vocabulary), np.int64)
        number[self.order] = np.arange(len(vocabulary)) + 2  # 0 ends the text, 1 separates
        number = dict(zip(vocabulary, number.tolist()))
        self.largest = len(vocabulary) + 1
        by_length = {}
        for window, names in windows.items():
            by_length.setdefault(len(window), []).append(([number[w] for w in window], sorted(names)))
        self.groups = [(n, np.array([w for w, _ in g], np.int64), [names for _, names in g]) for n, g in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)
        pairs = {number[a] * (self.largest + 1) + number[b] for w in windows for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def reduced(self, hashes, checks, first):
        """Symbols that can lie inside an occurrence, a separator after each run, and their word places."""
        if not self.groups or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        symbol = np.where((self.hashes[at] == hashes) & (self.checks[at] == checks), at + 2, 0)
        inside = symbol > 0
        new = np.ones(len(symbol) + 1, bool)
        new[1:-1] = True
        pair = symbol[:-1] * (self.largest + 1) + symbol[1:]
        if len(self.pairs):
            k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            new[1:-1] = ~((self.pairs[k] == pair) & inside[:-1] & inside[1:])
        new[first] = True
        cuts = np.flatnonzero(new)
        starts, lengths = cuts[:-1], np.diff(cuts)
        keep = inside[starts] & (lengths >= self.shortest)
        starts, lengths = starts[keep], lengths[keep]
        total = np.cumsum(lengths + 1)
        place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths - 1 - starts, lengths + 1)
        out = np.append(symbol, 1)[np.minimum(place, len(symbol))]
        out[total - 1] = 1
        return out, place


def occurrences(phrases, symbols, places):
    """(number of the item, first word, last word + 1) of every window found, as arrays."""
    found = []
    if len(symbols):
        index = FMIndex(symbols, phrases.largest)
        for n, numbers, names in phrases.groups:
            low, high = index.search(numbers)
            for k in np.flatnonzero(high > low):
                at = places[index.locate(np.arange(low[k], high[k]))]
                found += [(np.full(len(at), item, np.int64), at, at + n) for item in names[k]]
    if not found:
        return [np.zeros(0, np.int64)] * 3
    return [np.concatenate(x) for x in zip(*found)]


def merged(first, last, group):
    """Union of the ranges within each group; touching ranges merge. Returns index arrays."""
    order = np.lexsort((first, group))
    first, last, group = first[order], last[order], group[order]
    if not len(first):
        return first, last, group
    # ranges of a later group start after all of an earlier one once shifted
    shift = group * (int(last.max()) + 1)
    reach = np.maximum.accumulate(last + shift)
    new = np.concatenate(([True], (first + shift)[1:] > reach[:-1]))
    new[1:] |= group[1:] != group[:-1]
    head = np.flatnonzero(new)
    return first[head], np.maximum.reduceat(last, head), group[head]


def shard_hits(column, phrases, limit=1 << 18, shard=1 << 18):
    """Words of each row of a text column, and the hits as arrays: row, item, word and byte places in the row."""
    counts, hits, waiting, base = [], [], [], 0

    def search():
        nonlocal waiting
        symbols = [s for s, *_ in waiting]
        places = [p for _, p, *_ in waiting]
        item, first, last = occurrences(phrases, np.concatenate(symbols), np.concatenate(places))
        starts, ends, rows = (np.concatenate([x[k] for x in waiting]) for k in (2, 3, 4))
        origin = waiting[0][5]
        if len(item):
            names, group = np.unique(item, return_inverse=True)
            row = rows[first - origin]
            n_rows = int(rows.max()) + 1
            first, last, key = merged(first, last, group * n_rows + row)
            item, row = names[key // n_rows], key % n_rows
            order = np.lexsort((first, item, row))
            first, last, item, row = first[order], last[order], item[order], row[order]
            hits.append((row, item, first, last, starts[first - origin], ends[last - 1 - origin]))
        waiting = []

    seen = 0
    for low, data, offsets in W.text_pieces(column, limit):
        data = W.LOWER[data]
        starts, ends, first = W.word_spans(data, offsets, TABLE)
        hashes, checks = W.lane_hashes(data, starts, ends, True)
        symbols, places = phrases.reduced(hashes, checks, first)
        rows = W.row_numbers(first)
        counts.append(np.diff(first))
        waiting.append((symbols, places + base, starts - offsets[rows], ends - offsets[rows], rows + low, base))
        base += len(hashes)
        seen += len(symbols)
        if seen >= shard or base - waiting[0][5] >= 4 * shard:
            search()
            seen = 0
    if waiting:
        search()
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    empty = [np.zeros(0, np.int64)] * 6
    row, item, first, last, start, stop = [np.concatenate(x) for x in zip(*hits)] if hits else empty
    return counts, row, item, first - firsts[row], last - firsts[row], start, stop


def _with_hits(batches, phrases, kind, text, keep_text, words="_words", hits="_hits", old="_old"):
    items = pa.array(phrases.items, kind)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        counts, row, item, first, last, start, stop = shard_hits(column, phrases)
        out = pa.StructArray.from_arrays(
            [items.take(pa.array(item)), *(pa.array(x, pa.int32()) for x in (first, last, start, stop))],
            names=["item", "first", "last", "start", "stop"])
        borders = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(column)))))
        new = {words: pa.array(counts, pa.int32()), hits: W.lists(out, borders)}
        columns, names = [], []
        for name, col in zip(batch.schema.names, batch.columns):
            if name in new or name == text and not keep_text:
                continue
            columns.append(col)
            names.append(name)
        if hits in batch.schema.names:
            new[old] = batch.column(batch.schema.get_field_index(hits))
        yield pa.RecordBatch.from_arrays(columns + list(new.values()), names=names + list(new))


def _blocks(benchmark, most):
    """Lists of (item, words) of about `most` words, one held at a time; at least one list."""
    block, used = [], 0
    for r in benchmark.toLocalIterator():
        if r[0] is None:
            continue
        words = item_words(r[1])
        if used and used + len(words) > most:
            yield block
            block, used = [], 0
        block.append((r[0], words))
        used += len(words)
    yield block


def find(docs, benchmark, text="text", item_id="item_id", item_text="text", size=10, block_words=2_000_000, keep_text=False,
         words="_words", hits="_hits"):
    """`docs` with columns `words` (int) and `hits`, an array of the places of benchmark windows.

    A hit is one merged run of windows of one item: item, first and last + 1 word of the row,
    first and last + 1 byte of its UTF-8 text. Null texts and items have no words; an item
    of fewer than `size` words is one window, an item without words or id is never found; ids are of any atomic type. Repeated
    rows are judged each by itself; repeated items give one hit. Other columns pass through,
    the text only with `keep_text`; columns named as the new ones are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in (words, hits)])
    old = free(docs, "_old")
    hit = HIT.format(benchmark.select(item_id).schema[0].dataType.simpleString())
    kind = benchmark.select(item_id).limit(0).toArrow().schema.field(0).type
    ahead = _blocks(benchmark.select(item_id, item_text), block_words)
    block, k = next(ahead), -1
    while block is not None:
        phrases, k, block = docs.sparkSession.sparkContext.broadcast(Phrases(block, size)), k + 1, next(ahead, None)
        keep = keep_text or block is not None
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in (words, hits) and (f.name != text or keep)]
        fields += [f"`{words}` int", f"`{hits}` {hit}"] + ([f"`{old}` {hit}"] if k else [])
        docs = docs.mapInArrow(lambda b, p=phrases, keep=keep: _with_hits(b, p.value, kind, text, keep, words, hits, old), ", ".join(fields))
        if k:
            docs = docs.withColumn(hits, F.concat(old, hits)).drop(old)
    return docs


def _union(batch, low, high, hits="_hits"):
    """Merged [low, high) ranges of the hits of each row: row, first, last."""
    hits = batch.column(batch.schema.get_field_index(hits))
    flat = hits.flatten()
    row = np.repeat(np.arange(len(hits)), np.asarray(hits.value_lengths().fill_null(0)))
    first, last = (np.asarray(flat.field(x)).astype(np.int64) for x in (low, high))
    first, last, row = merged(first, last, row)
    return row, first, last


def _summary(batches, names):
    for batch in batches:
        row, first, last = _union(batch, "first", "last")
        hit = np.bincount(row, last - first, minlength=batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(hit)], names=[*names, "n_hit"])


def report(found, key="doc_id"):
    """One row per document of `find`: its words, hit words and items."""
    fields = ", ".join(f"`{n}` {found.schema[n].dataType.simpleString()}" for n in (key, "_words", "_hits"))
    rows = found.select(key, "_words", "_hits").mapInArrow(lambda b: _summary(b, [key, "_words", "_hits"]), f"{fields}, n_hit bigint")
    items = F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item"].cast("string"))))
    return rows.select(
        key, F.col("_words").cast("long").alias("n_words"), "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _cut(batches, text, names, hits):
    for batch in batches:
        row, start, stop = _union(batch, "start", "stop", hits)
        column = batch.column(batch.schema.get_field_index(text))
        changed = column.to_pylist()
        spans = {}
        for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist()):
            spans.setdefault(r, []).append((a, b))
        for r, cuts in spans.items():
            data, out, at = changed[r].encode(), [], 0
            for a, b in cuts:
                out.append(data[at:a])
                at = b
            changed[r] = b"\n".join([*out, data[at:]]).decode()
        new = pa.array(changed, column.type)
        yield pa.RecordBatch.from_arrays([new if n == text else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)


def remove(docs, benchmark, text="text", **options):
    """`docs` with the merged hit spans cut out of the text, a line break in place of each.

    Hit spans begin and end at words, so no character is split. Texts without hits are unchanged.
    """
    words, hits = free(docs, "_words"), free(docs, "_hits")
    found = find(docs, benchmark, text, keep_text=True, words=words, hits=hits, **options)
    return found.mapInArrow(lambda b, n=docs.columns: _cut(b, text, n, hits), docs.schema)
