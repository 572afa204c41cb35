"""Near-duplicate documents by DartMinHash over five-word shingles.

A shingle that stands c times in a text is an element of weight c; two texts are alike if their
weighted Jaccard similarity (sum of least counts over sum of greatest) is 0.8 or more.

Darts. Each unit of an element's weight is a region in which darts fall by a Poisson process over rank,
drawn from hashes of the shingle and the unit, so equal regions of two texts hold equal darts. A dart
also hits one of `k` coordinates. A text takes the darts below a rank that gives it a few per
coordinate, and keeps the earliest of each; if a coordinate stays empty, the rank is doubled for that
text. The kept darts' names are the signature, cut into bands; texts with an equal band are joined.

Exact copies are one class from the start. Candidates are checked on their full shingle counts: first each
text of a band's bucket against the least one. Where a bucket still holds texts of several components, all its
pairs across components are checked too, in blocks of bounded size, so no link is lost to the short cut.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm import words as W
from panelcast.llm.graph import components
from panelcast.llm.names import free
from panelcast.sources.files import store

SHINGLE, BANDS, ROWS = 5, 18, 4
K = BANDS * ROWS
BLOCK = 256


def shingle_units(data, offsets):
    """(hash of each unit region, shingle hash, unit number, row borders); units of one shingle count up from 0."""
    starts, ends, first = W.word_spans(data, offsets, W.PLAIN)
    shingles, first = W.shingle_hashes(W.lane_hashes(data, starts, ends), first, SHINGLE)
    rows = W.row_numbers(first)
    order = np.lexsort((shingles, rows))
    shingles = shingles[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
    head = np.flatnonzero(new)
    unit = np.arange(len(shingles)) - np.repeat(head, np.diff(np.append(head, len(shingles))))
    return W.mix(shingles + unit.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), shingles, unit, first


def dart_signatures(regions, first, k=K):
    """Signature (rows x k) of each row of regions; a row without regions has zeros."""
    n, size = len(first) - 1, np.diff(first)
    signature, earliest = np.zeros((n, k), np.uint64), np.full((n, k), np.inf)
    limit = np.where(size > 0, k * (np.log(k) + 2) / np.maximum(size, 1), 0.0)
    rows_left, region, row = np.flatnonzero(size > 0), regions, W.row_numbers(first)
    rank, dart = np.zeros(len(region)), np.zeros(len(region), np.uint64)
    while len(rows_left):
        waiting = []
        while len(region):
            dart = dart + np.uint64(1)
            draw = W.mix(region ^ (dart * np.uint64(0x9E3779B97F4A7C15)))
            after = rank - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = after < limit[row]
            waiting.append((region[~hit], row[~hit], rank[~hit], dart[~hit] - np.uint64(1)))
            region, row, rank, dart = region[hit], row[hit], after[hit], dart[hit]
            name = W.mix(draw[hit] + np.uint64(0x632BE59BD9B4E019))
            place = (name >> np.uint64(32)).astype(np.int64) % k
            # the earliest dart of each coordinate: sort by rank, keep firsts
            cell = row * k + place
            order = np.argsort(rank, kind="stable")[::-1]
            flat, names = earliest.ravel(), signature.ravel()
            cell, r, nm = cell[order], rank[order], name[order]
            last = np.full(n * k, -1, np.int64)
            last[cell] = np.arange(len(cell))
            best = last[last >= 0]
            better = best[r[best] < flat[cell[best]]]
            flat[cell[better]], names[cell[better]] = r[better], nm[better]
        empty = np.isinf(earliest[rows_left]).any(axis=1)
        rows_left = rows_left[empty]
        if len(rows_left):
            again = np.zeros(n, bool)
            again[rows_left] = True
            limit[rows_left] *= 2
            region, row, rank, dart = (np.concatenate(x) for x in zip(*waiting))
            keep = again[row]
            region, row, rank, dart = region[keep], row[keep], rank[keep], dart[keep]
    return signature


def _band_rows(batches):
    """(id, band, key) for each text with words."""
    salt = W.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for low, data, offsets in W.text_pieces(batch.column(1)):
            regions, _, _, first = shingle_units(data, offsets)
            signature = dart_signatures(regions, first)
            some = np.flatnonzero(np.diff(first) > 0)
            keys = np.zeros((len(some), BANDS), np.uint64)
            for j in range(ROWS):
                keys = W.mix(keys + signature[some][:, j::ROWS] * np.uint64(2 * j + 3))
            keys = W.mix(keys ^ salt)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some + low], BANDS)), pa.array(keys.ravel().view(np.int64))], names=["id", "key"])


def _shingle_lists(batches):
    """(id, sorted shingle regions) for each text; equal lists are equal multisets."""
    for batch in batches:
        for low, data, offsets in W.text_pieces(batch.column(1)):
            regions, _, _, first = shingle_units(data, offsets)
            rows = W.row_numbers(first)
            regions = regions.view(np.int64)
            order = np.lexsort((regions, rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(first) - 1), W.lists(regions[order], first, pa.int64())], names=["id", "units"])


def similarity(a, b):
    """Weighted Jaccard of two sorted arrays of distinct regions."""
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) > common else 0.0


def _checked(batches, threshold):
    """Pairs (src, dst, units, units2) that are alike."""
    for batch in batches:
        out = ([], [])
        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            x, y = np.asarray(x.values), np.asarray(y.values)
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and similarity(x, y) >= threshold:
                out[0].append(a)
                out[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["src", "dst"])


def _block_links(threshold):
    def run(table):
        """Links across components within one pair of blocks; texts already joined here are skipped."""
        rows = table.to_pylist()
        parent = {r["component"]: r["component"] for r in rows}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        units = [np.array(r["units"], np.int64) for r in rows]
        found = []
        for i in range(len(rows)):
            for j in range(i):
                if rows[i]["side"] == rows[j]["side"] != 2 or rows[i]["id"] == rows[j]["id"]:
                    continue
                a, b = root(rows[i]["component"]), root(rows[j]["component"])
                short, long = sorted((len(units[i]), len(units[j])))
                if a != b and short >= threshold * long and similarity(units[i], units[j]) >= threshold:
                    parent[max(a, b)] = min(a, b)
                    found.append((rows[i]["id"], rows[j]["id"]))
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])
    return run


def text_id(text):
    """64-bit id of a text (equal texts, equal id); a null text is empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def block_pairs(rows, group, block, share):
    """Give each row of a group to every pair of blocks that its block is part of.

    Groups are cut into ceil(n / block) blocks by the hash `share`; adds `pair` and `side` (2: both
    sides are one block), so that any two rows of a group meet in exactly one pair with sides
    that allow it.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
    rows = rows.join(sizes, group).withColumn("_own", F.pmod(share, F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    return rows.withColumn("pair", low * F.col("_blocks") + high).withColumn("side", side).drop("_blocks", "_own", "_other")


def links(docs, text="text", threshold=0.8):
    """(id, component) of texts that have a link: `id` is `_tid`, the text_id."""
    texts = docs.select("_tid", F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x20\x7F]"))
    bands = texts.mapInArrow(_band_rows, "id long, key long")
    counted = bands.groupBy("key", "id").agg(F.lit(1).alias("one"))
    buckets = counted.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    members = store(counted.join(buckets, "key").select("key", "id", "least"), "buckets")
    stars = members.filter("id <> least").select(F.col("id").alias("src"), F.col("least").alias("dst")).distinct()
    wanted = members.select("id").distinct()
    lists = texts.withColumnRenamed("_tid", "id").join(wanted, "id", "left_semi").mapInArrow(_shingle_lists, "id long, units array<long>")
    lists = store(lists.dropDuplicates(["id"]), "shingles")

    def checked(pairs):
        a = lists.select(F.col("id").alias("src"), F.col("units").alias("a"))
        b = lists.select(F.col("id").alias("dst"), F.col("units").alias("b"))
        rows = pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b")
        return rows.mapInArrow(lambda x: _checked(x, threshold), "src long, dst long")

    found = store(checked(stars), "links")
    groups = components(found)
    # buckets with texts of several components: all pairs across components, in blocks
    named = members.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("key")
    rest = store(named.join(mixed, "key"), "mixed")
    if rest.isEmpty():
        return groups
    rows = block_pairs(rest, ["key"], BLOCK, F.xxhash64("id")).join(lists, "id")
    more = rows.groupBy("key", "pair").applyInArrow(_block_links(threshold), "src long, dst long")
    return components(found.unionByName(more))


def _grouped(docs, doc_id, text, threshold):
    """(doc_id, _tid, component) per row, and the least (id, text) of each component with its rows."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("_tid", text_id("text"))
    groups = store(links(docs, "text", threshold), "components")
    rows = docs.select("doc_id", "_tid").join(groups.select(F.col("id").alias("_tid"), "component"), "_tid", "left")
    rows = rows.select("doc_id", "_tid", F.coalesce("component", "_tid").alias("component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tid"))
    return rows, rows.groupBy("component").agg(F.min(order).alias("least"), F.count("*").alias("n_copies"))


def classes(docs, doc_id="doc_id", text="text", threshold=0.8):
    """One row per row of `docs`: doc_id, class_id (least doc_id of its group), n_copies (rows of the
    group) and kept (whether it is the class's document).

    Texts without words (null, empty, blank) are alone with their exact copies. Rows that repeat a doc_id
    and text are one document, each with its own row here; null ids come last in a class.
    """
    rows, least = _grouped(docs, doc_id, text, threshold)
    rows = rows.join(least, "component")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("_tid") == F.col("least._tid"))
    return rows.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_copies", kept.alias("kept"))


def keep_one(docs, doc_id="doc_id", text="text", threshold=0.8):
    """One row of `docs` for each group of near copies, with all its columns."""
    _, least = _grouped(docs, doc_id, text, threshold)
    least = least.select(F.col("least.doc_id").alias("_id"), F.col("least._tid").alias("_tid"))
    key = free(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(doc_id), text_id(text)))
    kept = keyed.join(least.select(F.xxhash64("_id", "_tid").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(*docs.columns)
