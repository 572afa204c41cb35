"""Exact substring deduplication with a sampled suffix array.

Every 200-byte string (`length`) that stands in two places is found:

1. Anchors. In each window of `length` bytes the 40-byte gram with the least hash is an anchor.
   It depends on the window's bytes alone, so equal windows have an anchor at the same offset.
   Each anchor carries a hash of its context, the bytes of all windows that hold it.
2. Anchors with equal grams meet. Equal contexts are repeats as a whole. Where one gram has
   several contexts, one of each is fetched from its text.
3. These contexts are suffix-sorted, forwards and backwards from the anchor, by deep-shallow
   sorting: a multikey quicksort on eight-byte letters down to a shallow depth, then a blind
   trie for each group that is still tied. Neighbours' common prefixes tell which windows are equal.
4. The covered ranges of a document merge into its removed runs.

A gram with more than `group` different contexts isn't compared in one task: its windows are counted
by their hashes in an ordinary, pre-aggregated grouping, with the same result. Texts are never
compared in pairs. Hashes are 64 bits wide, and a document is told by the hash of its id and text.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from panelcast.llm import words as W
from panelcast.llm.names import free
from panelcast.sources.files import store

GRAM = 40


def anchors(data, offsets, length):
    """Row, place, gram hash, context hash, bytes left and right of each anchor."""
    n, empty = len(data), [np.zeros(0, np.int64)] * 6
    if n < length:
        return empty
    sums = W.prefix_sums(data)
    i = np.arange(n - GRAM + 1)
    grams = W.span_hashes(sums, i, i + GRAM)
    place = W.window_minima(grams, offsets, GRAM, length)
    row = np.searchsorted(offsets, place, "right") - 1
    low = np.maximum(offsets[row], place - (length - GRAM))
    high = np.minimum(offsets[row + 1], place + length)
    context = W.mix(W.span_hashes(sums, low, high) + (place - low).astype(np.uint64) * np.uint64(length + 1))
    return row, place - offsets[row], grams[place], context, place - low, high - place


def merge_ranges(group, low, high):
    """Union of ranges within each group, touching ones joined: group, low, high."""
    if not len(group):
        return group, low, high
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    shift = group * (int(high.max()) + 1)
    reach = np.maximum.accumulate(high + shift)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | ((low + shift)[1:] > reach[:-1])))
    head = np.flatnonzero(new)
    return group[head], low[head], np.maximum.reduceat(high, head)


def _anchor_rows(batches, length):
    """(key, gram, context, at): at packs place, left, right and whether the document has more of the same.

    Where one document repeats a gram with its context, only the first stands for it, and the ranges of
    all are given at once as rows without gram (at: low and high).
    """
    for batch in batches:
        keys = np.asarray(batch.column(0)).astype(np.int64)
        for first, data, offsets in W.text_pieces(batch.column(1)):
            row, place, gram, context, left, right = anchors(data, offsets, length)
            order = np.lexsort((place, context, gram, row))
            row, place, gram, context, left, right = (x[order] for x in (row, place, gram, context, left, right))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            run = np.cumsum(new) - 1
            many = np.bincount(run, minlength=1)[run] > 1 if len(run) else new
            own, low, high = merge_ranges(row[many], (place - left)[many], (place + right)[many])
            at = (place << 18 | left << 10 | right << 1 | many)[new]
            own_key, key = keys[own + first], keys[row[new] + first]
            nulls = np.concatenate((np.zeros(len(key), bool), np.ones(len(own), bool)))
            pad = np.zeros(len(own), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((key, own_key))),
                pa.array(np.concatenate((gram[new].view(np.int64), pad)), mask=nulls),
                pa.array(np.concatenate((context[new].view(np.int64), pad)), mask=nulls),
                pa.array(np.concatenate((at, low << 32 | high)))], names=["key", "gram", "context", "at"])


def blind_trie(strings):
    """Order of equally long byte strings: each is led down by single letters to some leaf, compared
    with it once, and branched off where they first differ."""
    size = len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    same = [[0]]  # indices of equal strings, by leaf
    root = 0  # a leaf is an int, a node is (depth, {letter: child})
    for k in range(1, len(strings)):
        s = strings[k]
        node = root
        while not isinstance(node, int):
            child = node[1].get(s[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = same[node][0]
        differ = numbers[k] ^ numbers[other]
        if not differ:
            same[node].append(k)
            continue
        depth = size - (differ.bit_length() + 7) // 8
        leaf = len(same)
        same.append([k])
        parent, node = None, root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = leaf
            continue
        branch = (depth, {strings[other][depth]: node, s[depth]: leaf})
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out += same[node]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(letters, shallow=48):
    """Sort the rows of a byte matrix; returns the order and each row's common prefix with the one before."""
    n, size = letters.shape
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = letters
    wide = wide.view(">u8").astype(np.uint64)
    order, tied = np.arange(n), np.zeros(n, np.int64)
    for depth in range(min(wide.shape[1], shallow // 8)):
        again = np.lexsort((wide[order, depth], tied))
        order, tied = order[again], tied[again]
        letter = wide[order, depth]
        tied = np.cumsum(np.concatenate(([False], (letter[1:] != letter[:-1]) | (tied[1:] != tied[:-1]))))
    borders = np.flatnonzero(np.concatenate(([True], tied[1:] != tied[:-1], [True])))
    for low, high in zip(borders[:-1][np.diff(borders) > 1], borders[1:][np.diff(borders) > 1]):
        part = order[low:high]
        order[low:high] = part[blind_trie([letters[k].tobytes() for k in part])]
    common = np.zeros(n, np.int64)
    for low in range(1, n, 1 << 14):
        a, b = letters[order[low:low + (1 << 14)]], letters[order[low - 1:low - 1 + (1 << 14)]][:n - low]
        differ = a != b
        common[low:low + len(a)] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return order, common


def equal_windows(forward, backward, left, right, length):
    """For each anchor the least and the most bytes before it at which one of its windows equals another's.

    Windows with `i` bytes before the anchor are equal if the backward strings agree on i letters and
    the forward strings on length - i. Returns (least, most); most is -1 if there is none.
    """
    n = len(left)
    order_f, common_f = deep_shallow(forward)
    order_b, common_b = deep_shallow(backward)
    least, most = np.full(n, length), np.full(n, -1)
    class_f, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(length - GRAM + 1):
        rows = np.flatnonzero((left >= i) & (right >= length - i))
        if len(rows) < 2:
            continue
        class_f[order_f] = np.cumsum(common_f < length - i)
        class_b[order_b] = np.cumsum(common_b < i)
        code = class_f[rows] * (n + 1) + class_b[rows]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        twice = rows[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        least[twice] = np.minimum(least[twice], i)
        most[twice] = i
    return least, most


def _contexts(batches, length):
    """Fetch the contexts that were asked for: (key, texts, asked) to one row per context."""
    for batch in batches:
        data, offsets = W.column_bytes(batch.column(1))
        asked = batch.column(2)
        flat = asked.flatten()
        row = np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths()))
        at = np.asarray(flat.field("at")).astype(np.int64)
        place, left, right = at >> 18, at >> 10 & 255, at >> 1 & 511
        low = offsets[row] + place - left
        size = left + right
        borders = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(low - borders[:-1], size) + np.arange(borders[-1])
        raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[take]))])
        yield pa.RecordBatch.from_arrays(
            [flat.field("gram"), batch.column(0).take(pa.array(row)), flat.field("at"), flat.field("single"), raw],
            names=["gram", "key", "at", "single", "raw"])


def _matrices(raw, left, right, length):
    """Forward letters from the anchor and backward letters before it, filled up with zeros."""
    borders = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1 + raw.offset)[raw.offset:].astype(np.int64)
    data = np.concatenate((np.frombuffer(raw.buffers()[2], np.uint8), np.zeros(1, np.uint8)))
    here = (borders[:-1] + left)[:, None]
    step = np.arange(length)
    forward = data[np.where(step < right[:, None], here + step, len(data) - 1)]
    step = np.arange(length - GRAM)
    backward = data[np.where(step < left[:, None], here - 1 - step, len(data) - 1)]
    return forward, backward


def _sorted_groups(batches, length, rows=8192):
    """Ranges of the single contexts; batches come sorted by gram, and a gram is never cut."""
    def ranges(table):
        at = np.asarray(table["at"]).astype(np.int64)
        left, right = at >> 10 & 255, at >> 1 & 511
        raw = table["raw"].combine_chunks()
        least, most = equal_windows(*_matrices(raw, left, right, length), left, right, length)
        hit = np.asarray(table["single"]) & (most >= 0)
        place = (at >> 18)[hit]
        keys = np.asarray(table["key"])[hit]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(place - most[hit]), pa.array(place - least[hit] + length)], names=["key", "low", "high"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= rows:
            grams = np.asarray(held["gram"])
            others = np.flatnonzero(grams != grams[-1])
            if len(others):
                cut = int(others[-1]) + 1
                yield ranges(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield ranges(held.combine_chunks())


def _window_hashes(batches, length):
    for batch in batches:
        raw = batch.column(4)
        at = np.asarray(batch.column(2)).astype(np.int64)
        left, right = at >> 10 & 255, at >> 1 & 511
        borders = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1 + raw.offset)[raw.offset:].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[borders[0]:borders[-1]]
        sums, here = W.prefix_sums(data), borders[:-1] - borders[0] + left
        low = np.maximum(0, length - right)
        count = np.maximum(0, np.minimum(left, length - GRAM) - low + 1)
        row = np.repeat(np.arange(len(raw)), count)
        before = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = here[row] - before
        hashes = W.span_hashes(sums, start, start + length).view(np.int64)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(before), pa.array(hashes), batch.column(1).take(rows), pa.array(at[row] >> 18), batch.column(3).take(rows)],
                                         names=["gram", "before", "hash", "key", "place", "single"])


def document_key(doc_id, text):
    return F.xxhash64(F.col(doc_id), F.col(text))


def spans(docs, key="_key", text="text", length=200, group=100_000):
    """(key, ranges): byte ranges of each text covered by `length`-byte strings that stand elsewhere too.

    `docs` has a 64-bit key per document. Rows with equal key and text are copies of each other. The
    ranges of a key overlap and aren't sorted; keys without ranges are missing.
    """
    assert GRAM < length <= 255
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") >= length)
    rows = texts.mapInArrow(lambda b: _anchor_rows(b, length), "key long, gram long, context long, at long")
    rows = rows.repartition(F.coalesce("gram", "key"))
    gram, context = Window.partitionBy(F.coalesce("gram", "key")), Window.partitionBy(F.coalesce("gram", "key"), "context")
    many = F.lit(1) + F.col("at").bitwiseAND(1)
    rows = (rows.withColumn("rep", F.row_number().over(context.orderBy("key", "at")) == 1)
            .withColumn("like", F.sum(many).over(context))
            .withColumn("all", F.sum(many).over(gram)).withColumn("least", F.min("like").over(gram))
            .withColumn("reps", F.sum(F.col("rep").cast("int")).over(gram)))
    whole = F.col("gram").isNull() | (F.col("like") > 1)
    asked = F.col("gram").isNotNull() & F.col("rep") & (F.col("like") < F.col("all")) & (F.col("least") == 1)
    met = store(rows.filter(whole | asked).select("key", "gram", "at", whole.alias("whole"), asked.alias("asked"), "reps"), "anchors")

    place = F.shiftright("at", 18)
    covered = met.filter("whole").select(
        "key", F.when(F.col("gram").isNull(), F.shiftright("at", 32)).otherwise(place - F.shiftright("at", 10).bitwiseAND(255)).alias("low"),
        F.when(F.col("gram").isNull(), F.col("at").bitwiseAND(0xFFFFFFFF)).otherwise(place + F.shiftright("at", 1).bitwiseAND(511)).alias("high"))

    ask = met.filter("asked").select("key", "gram", "at", (~F.col("whole")).alias("single"), "reps")

    def fetched(ask):
        wanted = ask.groupBy("key").agg(F.collect_list(F.struct("gram", "at", "single")).alias("asked"))
        joined = texts.join(wanted, "key").select("key", "text", "asked")
        return joined.mapInArrow(lambda b: _contexts(b, length), "gram long, key long, at long, single boolean, raw binary")

    contexts = fetched(ask.select("key", "gram", "at", "single"))
    big = ask.filter(F.col("reps") > group).select("gram").distinct()
    hot = None
    if not big.isEmpty():
        contexts = store(contexts, "contexts")
        hot, contexts = contexts.join(big, "gram", "left_semi"), contexts.join(big, "gram", "left_anti")
    usual = contexts.repartition("gram").sortWithinPartitions("gram")
    parts = [covered, usual.mapInArrow(lambda b: _sorted_groups(b, length), "key long, low long, high long")]
    if hot is not None:
        hot = hot.select("gram", "key", "at", "single", "raw")
        windows = hot.mapInArrow(lambda b: _window_hashes(b, length), "gram long, before long, hash long, key long, place long, single boolean")
        same = ["gram", "before", "hash"]
        twice = windows.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        hit = windows.filter("single").join(twice, same).groupBy("key", "place").agg(F.min("before").alias("a"), F.max("before").alias("b"))
        parts.append(hit.select("key", (F.col("place") - F.col("b")).alias("low"), (F.col("place") - F.col("a") + length).alias("high")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def _row_spans(batch, column="_ranges"):
    """Merged ranges of each row of a batch, in row order: row, low, high."""
    ranges = batch.column(batch.schema.get_field_index(column))
    flat = ranges.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.asarray(ranges.value_lengths().fill_null(0)))
    return merge_ranges(row, np.asarray(flat.field("low")).astype(np.int64), np.asarray(flat.field("high")).astype(np.int64))


def _report(batches):
    for batch in batches:
        row, low, high = _row_spans(batch)
        data, offsets = W.column_bytes(batch.column(1))
        n = batch.num_rows
        at = np.searchsorted(row, np.arange(n + 1))
        raw, digests = memoryview(data), []
        for k in range(n):
            digest, here = hashlib.sha256(), int(offsets[k])
            for j in range(at[k], at[k + 1]):
                digest.update(raw[here:int(offsets[k] + low[j])])
                here = int(offsets[k] + high[j])
            digest.update(raw[here:int(offsets[k + 1])])
            digests.append(digest.hexdigest())
        removed = np.bincount(row, high - low, minlength=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(at).astype(np.int64)), pa.array(digests, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs, doc_id="doc_id", text="text", length=200):
    """One row per row of `docs`: bytes, removed bytes, removed runs and the digest of what stays.

    A null text is empty. Rows with equal id and text are copies of each other, as are all rows with
    one text. Null ids are reported as null.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("_key", document_key("doc_id", "text"))
    found = spans(docs, length=length).select(F.col("key").alias("_key"), F.col("ranges").alias("_ranges"))
    rows = docs.join(found, "_key", "left").select("doc_id", "text", "_ranges")
    return rows.mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(batches, text, names, ranges):
    for batch in batches:
        row, low, high = _row_spans(batch, ranges)
        column = batch.column(batch.schema.get_field_index(text))
        texts = column.to_pylist()
        own = {}
        for k, a, b in zip(row.tolist(), low.tolist(), high.tolist()):
            own.setdefault(k, []).append((a, b))
        for k, cuts in own.items():
            data, out, here = texts[k].encode(), [], 0
            for a, b in cuts:
                while a < b and data[a] & 0xC0 == 0x80:  # whole characters only
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                out.append(data[here:a])
                here = b
            texts[k] = b"".join([*out, data[here:]]).decode()
        new = pa.array(texts, column.type)
        yield pa.RecordBatch.from_arrays([new if c == text else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)


def remove(docs, doc_id="doc_id", text="text", length=200):
    """`docs` with all repeated bytes cut out of the texts; a cut never splits a character.

    Runs that begin or end inside a character lose the bytes of that character. Null texts stay null.
    """
    key, ranges = free(docs, "_key"), free(docs, "_ranges")
    keyed = docs.withColumn(key, document_key(doc_id, text))
    found = spans(keyed, key, text, length).select(F.col("key").alias(key), F.col("ranges").alias(ranges))
    return keyed.join(found, key, "left").mapInArrow(lambda b, n=docs.columns: _cut(b, text, n, ranges), docs.schema)
