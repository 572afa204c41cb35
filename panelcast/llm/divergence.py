"""How far the vocabulary of each source of a language is from that of the language and of its other sources.

Terms are runs of ASCII letters and of bytes above 127, A to Z lower-cased. A language keeps the terms that stand in
at least `LEAST` of its documents (rows). They are found by iceberg prefix refinement: level by level the terms are
cut to a byte prefix, twice as long each time; prefixes in fewer documents than the threshold end, and only terms
whose prefix goes on are looked at on the next level. A term no longer than the level's prefix is complete, and is kept if
its own count of documents reaches the threshold. No table of all terms is ever made: a term seen once is dropped with its prefix.

The prefixes that go on reach the tasks as a map of 2**`BITS` bits, whatever their number. Two prefixes may share a
bit; such a prefix is looked at once more and dropped by its exact count, so the result doesn't depend on the size.

Null text, language and source are empty strings. Shares are whole billionths, p = 1 + floor(1e9 (count + 1) / (N + V)), with
N occurrences of the V kept terms in a group; f = floor((p - q)^2 / q). Every (lang, source) that occurs is a group,
even without terms. Groups are compared term by term in tiles of `TILE` sources by slices of the terms.
"""
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F

from panelcast.llm import words as W
from panelcast.sources.files import store

LEAST, BITS, FIRST_LEVEL = 3, 24, 4
TILE, SLICE, TOP = 256, 1 << 18, 200
UNIT = 1_000_000_000
LETTER = W.byte_classes({*range(65, 91), *range(97, 123), *range(128, 256)})


def _terms(data, starts, ends):
    """Arrow array of the byte strings [starts, ends) of `data`, in order and without overlap."""
    size = ends - starts
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    borders = np.concatenate(([0], np.cumsum(size)))
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(borders), pa.py_buffer(data[inside])])


def _spelled(data, borders):
    """For each row its distinct terms and their numbers: (terms, counts, row borders)."""
    data = W.LOWER[data]
    starts, ends, first = W.word_spans(data, borders, LETTER)
    coded = _terms(data, starts, ends).dictionary_encode()
    pairs, counts = np.unique(W.row_numbers(first) * max(len(coded.dictionary), 1) + np.asarray(coded.indices), return_counts=True)
    rows, ids = np.divmod(pairs, max(len(coded.dictionary), 1))
    return coded.dictionary.take(pa.array(ids)), counts, np.searchsorted(rows, np.arange(len(borders)))


def _spelled_long(data):
    """The same for one long text, which is cut where a term ends."""
    low, limit, total = 0, 1 << 20, Counter()
    while low < len(data):
        high = min(low + limit, len(data))
        while high < len(data):
            gaps = np.flatnonzero(LETTER[data[high:high + limit]] == 0)
            if len(gaps):
                high += int(gaps[0])
                break
            high = min(high + limit, len(data))
        terms, counts, _ = _spelled(data[low:high], np.array([0, high - low]))
        total.update(dict(zip(terms.to_pylist(), counts.tolist())))
        low = high
    return pa.array(list(total), pa.large_binary()), np.array(list(total.values()), np.int64), np.array([0, len(total)])


def _spell(batches):
    for batch in batches:
        data, offsets = W.column_bytes(batch.column(2))
        for low, high in W.pieces(offsets, 1 << 19):
            piece, borders = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
            terms, counts, first = _spelled_long(piece) if high == low + 1 and len(piece) > 1 << 21 else _spelled(piece, borders)
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), terms), pa.scalar(b" ", pa.large_binary()))
            sizes = np.diff(first) * 4
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes),
                                           [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(counts.astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), joined.cast(pa.binary()), packed.cast(pa.binary())],
                names=["lang", "source", "terms", "counts"])


def spell(docs, text="text", lang="lang", source="source"):
    """lang, source, distinct terms of each document joined by spaces, and their counts as 32-bit numbers."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return rows.mapInArrow(_spell, "lang string, source string, terms binary, counts binary")


def _slots(data, starts, ends, langs, bits):
    """Bit of each (language, byte string) in a map of 2**bits."""
    return (W.mix(W.lane_hashes(data, starts, ends) ^ langs) >> np.uint64(64 - bits)).astype(np.int64)


def _lang_hashes(column):
    coded = column.dictionary_encode()
    data, offsets = W.column_bytes(coded.dictionary)
    return W.lane_hashes(data, offsets[:-1], offsets[1:])[np.asarray(coded.indices)]


def _level(batches, before, level, alive):
    """Of terms longer than `before` bytes whose prefix of that length is alive: counts by prefix of `level` bytes, added up
    over a piece. Complete terms carry their source, cut ones don't."""
    for batch in batches:
        langs, groups = _lang_hashes(batch.column(0)), [c.dictionary_encode() for c in batch.columns[:2]]
        group = np.asarray(groups[0].indices).astype(np.int64) * max(len(groups[1].dictionary), 1) + np.asarray(groups[1].indices)
        blob = batch.column(2).cast(pa.large_binary())
        offsets = np.frombuffer(blob.buffers()[1], np.int64, len(blob) + 1 + blob.offset)[blob.offset:]
        for low, high in W.pieces(offsets, 1 << 20):
            data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[offsets[low]:offsets[high]]
            starts, ends, first = W.word_spans(data, offsets[low:high + 1] - offsets[low], LETTER)
            counts = np.frombuffer(b"".join(batch.column(3).slice(low, high - low).to_pylist()), "<i4").astype(np.int64)
            rows = W.row_numbers(first) + low
            some = ends - starts > before
            starts, ends, counts, rows = starts[some], ends[some], counts[some], rows[some]
            if alive is not None:
                slot = _slots(data, starts, starts + before, langs[rows], len(alive).bit_length() + 5)
                some = (alive[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                starts, ends, counts, rows = starts[some], ends[some], counts[some], rows[some]
            cut = ends - starts > level
            keys = _terms(data, starts, np.where(cut, starts + level, ends)).dictionary_encode()
            size = max(len(keys.dictionary), 1)
            # one entry for each (document, prefix): the number of documents is the number of entries
            whole = np.unique((rows * 2 + cut) * size + np.asarray(keys.indices), return_inverse=True)
            occurrences = np.bincount(whole[1], weights=counts, minlength=len(whole[0])).astype(np.int64)
            row, key = np.divmod(whole[0], size)
            row, cut = row >> 1, row & 1
            of = np.where(cut, np.asarray(groups[0].indices)[row], group[row])
            one, at, n = np.unique((of * 2 + cut) * size + key, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=occurrences, minlength=len(one)).astype(np.int64)
            of, key = np.divmod(one, size)
            of, cut = of >> 1, (of & 1).astype(bool)
            width = max(len(groups[1].dictionary), 1)
            lang = groups[0].dictionary.take(pa.array(np.where(cut, of, of // width)))
            source = pc.if_else(pa.array(cut), pa.scalar(None, pa.string()), groups[1].dictionary.take(pa.array(np.where(cut, 0, of % width))))
            yield pa.RecordBatch.from_arrays(
                [lang, source, keys.dictionary.take(pa.array(key)).cast(pa.binary()), pa.array(cut), pa.array(n), pa.array(total)],
                names=["lang", "source", "term", "cut", "docs", "n"])


def _marks(batches, size):
    """Words of the bit map that the prefixes of a task set."""
    for batch in batches:
        data, offsets = W.column_bytes(batch.column(1).cast(pa.large_binary()).view(pa.large_string()))
        slot = np.unique(_slots(data, offsets[:-1], offsets[1:], _lang_hashes(batch.column(0)), size))
        word, at = np.unique(slot >> 6, return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (slot & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])


def kept_terms(spelled, least=LEAST, bits=BITS):
    """(lang, source, term, n) of the terms in at least `least` documents of their language, from `spell`'s table."""
    spark, parts = spelled.sparkSession, []
    before, level, alive = 0, FIRST_LEVEL, None
    while True:
        def run(batches, before=before, level=level, alive=alive):
            return _level(batches, before, level, alive and alive.value)
        counts = spelled.mapInArrow(run, "lang string, source string, term binary, cut boolean, docs long, n long")
        counts = store(counts.groupBy("lang", "source", "term", "cut").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "prefixes")
        whole = counts.filter("not cut")
        frequent = whole.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
        parts.append(whole.join(frequent.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
        marks = counts.filter("cut").filter(F.col("docs") >= least).select("lang", "term").mapInArrow(lambda b: _marks(b, bits), "word long, bits long")
        marks = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**bits / 64 rows
        if not len(marks):
            break
        words = np.zeros(1 << bits - 6, np.uint64)
        words[np.asarray(marks["word"])] = np.asarray(marks["bits"]).view(np.uint64)
        alive = spark.sparkContext.broadcast(words)
        before, level = level, 2 * level
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return store(out.withColumn("term", F.col("term").cast("string")), "kept-terms")


def _share(n, total, terms):
    """p in billionths; decimals, so that no count overflows."""
    return f"1 + cast({UNIT} * (cast({n} as decimal(19,0)) + 1) as decimal(38,0)) div ({total} + {terms})"


def group_sizes(groups, kept):
    """One row per group: lang, source, sid (number of the source in its language), total (N), terms (V), p0 (share of an absent term)."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    rows = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    rows = rows.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return rows.withColumn("p0", F.expr("case when terms > 0 then " + _share(0, "total", "terms") + " end"))


def _tile(key, terms, sizes, tile):
    """Summed f for all ordered pairs of sources of a pair of tiles over one slice of the terms, and the number of terms."""
    sids = np.asarray(sizes["g_sid"]).astype(np.int64)
    order = np.argsort(sids)
    sids, p0 = sids[order], np.asarray(sizes["g_p0"]).astype(np.int64)[order]
    size, n = len(sids), 0
    total, step = np.zeros((size, size), np.int64), max(1, (1 << 20) // (size * size))
    if len(terms):
        coded = terms["term"].combine_chunks().dictionary_encode()
        at, n = np.asarray(coded.indices), len(coded.dictionary)
        order = np.argsort(at)
        at, which, p = at[order], np.searchsorted(sids, np.asarray(terms["sid"]).astype(np.int64))[order], np.asarray(terms["p"])[order]
    for low in range(0, n, step):
        some = slice(*np.searchsorted(at, [low, low + step]))
        shares = np.tile(p0, (min(step, n - low), 1))
        shares[at[some] - low, which[some]] = p[some]
        gap = shares[:, :, None] - shares[:, None, :]
        total += (gap * gap // shares[:, None, :]).sum(0)
    lang, low, high, _ = (k.as_py() for k in key)
    a, b = np.divmod(np.arange(size * size), size)
    # pairs inside a tile come from that tile alone
    mine = (a != b) & ((sids[a] // tile != sids[b] // tile) if low != high else True)
    return pa.table({"lang": pa.array([lang] * int(mine.sum()), pa.string()), "sid": sids[a][mine], "other": sids[b][mine],
                     "value": total[a, b][mine], "seen": np.full(int(mine.sum()), n)})


def source_pairs(kept, sizes, tile=TILE, slice_rows=SLICE):
    """(lang, source, item, value): f from each source to each other one of its language, summed over all kept terms.

    A term that two sources don't hold counts with their shares of an absent term.
    """
    tiles = F.sequence(F.lit(0), F.floor((F.col("most") - 1) / tile).cast("int"))
    wide = store(sizes.join(sizes.groupBy("lang").agg(F.count("*").alias("most")), "lang").withColumn(
        "pair", F.explode(F.transform(tiles, lambda t: F.struct(F.least(t, F.floor(F.col("sid") / tile).cast("int")).alias("low"),
                                                                F.greatest(t, F.floor(F.col("sid") / tile).cast("int")).alias("high"))))), "tiles")
    wide = wide.select("lang", "source", "sid", "total", "terms", "p0", "pair.low", "pair.high")
    slices = 1 + kept.count() // slice_rows
    rows = kept.join(wide, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "terms")))
    rows = rows.withColumn("slice", F.expr(f"pmod(xxhash64(term), {slices})")).select("lang", "low", "high", "slice", "term", "sid", "p")
    fixed = wide.filter("terms > 0").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))) \
        .toDF(*[f"g_{c}" for c in wide.columns], "g_slice")
    keys = ["lang", "low", "high", "slice"]
    sums = rows.groupBy(*keys).cogroup(fixed.groupBy(*[f"g_{k}" for k in keys])).applyInArrow(lambda k, a, b: _tile(k, a, b, tile), "lang string, sid long, other long, value long, seen long")
    sums = sums.groupBy("lang", "sid", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    left = sizes.select("lang", "source", "sid", "terms", "p0")
    right = sizes.select("lang", F.col("source").alias("item"), F.col("sid").alias("other"), F.col("p0").alias("q0"))
    every = left.join(right, "lang").filter("sid <> other").join(sums, ["lang", "sid", "other"], "left").na.fill(0, ["value", "seen"])
    rest = F.expr("case when terms > 0 then (terms - seen) * ((p0 - q0) * (p0 - q0) div q0) else 0 end")
    return every.select("lang", "source", "item", (F.col("value") + rest).alias("value"))


def marked_terms(kept, sizes, top=TOP):
    """(lang, source, item, value): the terms a source uses more than its language does, the `top` with greatest f."""
    whole = kept.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    of_lang = sizes.groupBy("lang").agg(F.sum("total").alias("all_total"))
    rows = kept.join(sizes.select("lang", "source", "total", "terms"), ["lang", "source"]).join(whole, ["lang", "term"]).join(of_lang, "lang")
    rows = rows.withColumns({"p": F.expr(_share("n", "total", "terms")), "q": F.expr(_share("all_n", "all_total", "terms"))}).filter("p > q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return ranked(rows, "pmod(xxhash64(item), 64)").filter(F.col("rank") <= top).select("lang", "source", "item", "value") if top else rows


def ranked(rows, *parts):
    """`rank` from 1 in each group, value descending, then item ascending by bytes."""
    order = Window.partitionBy("lang", "source", *[F.expr(p) for p in parts]).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs, text="text", lang="lang", source="source", least=LEAST, top=TOP, bits=BITS, tile=TILE, slice_rows=SLICE):
    """lang, source, part, item, value, rank: part `pair` (all other sources) and part `term` (the `top` terms) of each group."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    kept = kept_terms(store(spell(docs, text, lang, source), "spelled"), least, bits)
    sizes = store(group_sizes(groups, kept), "group-sizes")
    pair = ranked(source_pairs(kept, sizes, tile, slice_rows)).withColumn("part", F.lit("pair"))
    term = ranked(marked_terms(kept, sizes, top)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")
