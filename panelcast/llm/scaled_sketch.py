"""Document fingerprints as threshold-scaled sketches.

The sketch of a text is every hash of its five-word shingles below a fixed fraction of the hash range, so a long text
has a long sketch and sketches of a 100-word and a 100,000-word text can be compared: the share of one's hashes that
the other holds estimates how much of it the other contains. A text with no hash below the fraction keeps its least
hash. Both rules depend on the set of shingles alone, so the sketch of two texts together is `merged` from theirs.

A text of fewer than five words has one shingle of all its words, one without words has an empty sketch; null is empty.
Two empty sketches are alike (1), an empty and another one are not (0). Words are runs of bytes other than ASCII white
space and control bytes, as they stand. Texts are cut into pieces at white space, so memory follows the piece.
"""
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from panelcast.llm import words as W
from panelcast.llm.names import free

SHINGLE, FRACTION = 5, 1 / 4
#: Sampled keys for each border between ranges of documents.
PER_RANGE = 20
#: A range holds about this many documents, fewer where there are more shuffle partitions.
RANGE = 10_000


def _word_hashes(data):
    """Hashes of the words of one text, piece by piece; pieces end at a byte that separates words."""
    low, limit = 0, 1 << 18
    while low < len(data):
        high = min(low + limit, len(data))
        while high < len(data):
            gaps = np.flatnonzero(W.PLAIN[data[high:high + limit]] == 0)
            if len(gaps):
                high += int(gaps[0])
                break
            high = min(high + limit, len(data))
        piece = data[low:high]
        starts, ends, _ = W.word_spans(piece, np.array([0, len(piece)]), W.PLAIN)
        yield W.lane_hashes(piece, starts, ends)
        low = high


def _kept(shingles, rows, fraction):
    """Sorted distinct (row, hash) below the fraction, and the least hash of each row."""
    below = shingles < np.uint64(int(fraction * 2**64))
    some, hashes = rows[below], shingles[below]
    order = np.lexsort((hashes, some))
    some, hashes = some[order], hashes[order]
    new = np.ones(len(some), bool)
    new[1:] = (some[1:] != some[:-1]) | (hashes[1:] != hashes[:-1])
    return some[new], hashes[new]


def _sketch_long(data, fraction):
    """Sketch of one long text, whose shingles are never held at once."""
    tail, parts, least, seen = np.zeros(0, np.uint64), [], None, 0
    for hashes in _word_hashes(data):
        seen += len(hashes)
        hashes = np.concatenate((tail, hashes))
        tail = hashes[-(SHINGLE - 1):]
        if seen < SHINGLE:
            continue
        shingles, first = W.shingle_hashes(hashes, np.array([0, len(hashes)]), SHINGLE)
        least = min(int(shingles.min()), least if least is not None else 2**64)
        parts.append(_kept(shingles, np.zeros(len(shingles), np.int64), fraction)[1])
    if least is None:
        return W.shingle_hashes(tail, np.array([0, len(tail)]), SHINGLE)[0]
    out = np.unique(np.concatenate(parts))
    return out if len(out) else np.array([least], np.uint64)


def sketches(texts, fraction=FRACTION):
    """Sketch of each text of an Arrow column: sorted hashes and row borders."""
    data, offsets = W.column_bytes(texts)
    hashes, sizes = [], []
    for low, high in W.pieces(offsets):
        piece, borders = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        if high == low + 1 and len(piece) > 1 << 19:
            one = _sketch_long(piece, fraction)
            hashes.append(one)
            sizes.append(np.array([len(one)]))
            continue
        starts, ends, first = W.word_spans(piece, borders, W.PLAIN)
        shingles, first = W.shingle_hashes(W.lane_hashes(piece, starts, ends), first, SHINGLE)
        rows, kept = _kept(shingles, W.row_numbers(first), fraction)
        size = np.bincount(rows, minlength=high - low)
        bare = np.flatnonzero((size == 0) & (np.diff(first) > 0))
        if len(bare):
            least = np.array([shingles[first[k]:first[k + 1]].min() for k in bare], np.uint64)
            at = np.searchsorted(rows, bare)
            kept = np.insert(kept, at, least)
            size[bare] = 1
        hashes.append(kept)
        sizes.append(size)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(size)))


def _longs(texts, fraction):
    hashes, first = sketches(texts, fraction)
    return W.lists(hashes.view(np.int64), first, pa.int64())


def fingerprint(docs, text="text", keep=("doc_id",), fraction=FRACTION, sketch="sketch"):
    """`keep` and the sketch of each text, an array of longs in ascending unsigned order. Nothing is shuffled."""
    rows = docs.select(*keep, F.col(text).alias(free(docs.select(*keep), "text")))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(sketch, T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _longs(batch.columns[-1], fraction)], names=schema.names)
    return rows.mapInArrow(run, schema)


def likeness(a, b):
    """Estimated share of common shingles among all shingles of two texts."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def contained(a, b):
    """Estimated share of the first text's shingles that the second holds."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a, b, fraction=FRACTION):
    """Sketch of two texts together (of their sets of shingles); `fraction` is at most a half."""
    every = F.array_union(a, b)
    below = F.array_sort(F.filter(every, lambda x: (x >= 0) & (x < int(fraction * 2**64))))
    turn = F.lit(-(2**63))  # orders signed numbers as unsigned ones
    least = F.array_min(F.transform(every, lambda x: x.bitwiseXOR(turn))).bitwiseXOR(turn)
    return F.when((F.size(below) > 0) | (F.size(every) == 0), below).otherwise(F.array(least))


def written(sketch):
    """The sketch as text: sixteen hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _ranges(keys, n):
    """About `n` keys (doc_id, hash), the first of each range of about equal size, in order; None where there is no row."""
    head = keys.agg(F.count("*").alias("n"), F.max("doc_id").alias("id")).first()
    if not head.n:
        return None
    n = n or max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), head.n // RANGE)
    top = keys.filter(F.col("doc_id").eqNullSafe(F.lit(head.id).cast("long"))).agg(F.min("_h")).first()[0]
    share = min(1.0, PER_RANGE * n / head.n)
    some = keys.filter(F.xxhash64(F.lit(29), "doc_id", "_h") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).distinct()
    ordered = sorted(((r.doc_id, r["_h"]) for r in some.collect()), key=_order)[::PER_RANGE]  # about PER_RANGE * n keys
    return sorted({(head.id, top), *ordered}, key=_order)


def _order(key):
    return (key[0] is None, ~(key[0] or 0), key[1])


def beside_next(docs, doc_id="doc_id", text="text", fraction=FRACTION, partitions=None):
    """Each document, its text edited with the next one's, and the sketches of the text, the edited and the next text.

    Documents go by descending id, null ids last, rows of one id by a hash of their text; the last is followed by the first, a
    single one by itself. The edited text has its last floor(n/2) characters replaced by as many first ones of the next text.
    Columns: doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch.

    Ranges of ids, cut at keys that stand in the table, are sorted each in its task; the first document of a range is also
    sent to the range before, so every text is shuffled once, and a task sees one range, row by row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    borders = _ranges(rows.select("doc_id", "_h"), partitions)
    schema = "doc_id long, n_chars long, edited_sha256 string, sketch array<long>, edited_sketch array<long>, next_sketch array<long>"
    if borders is None:
        return spark.createDataFrame([], schema)
    marks = pd.DataFrame([_order(b) for b in borders], columns=["bare", "id", "hash"])
    known, last = set(marks.itertuples(index=False, name=None)), len(borders) - 1

    @F.pandas_udf("part int, leads boolean")
    def place(bare: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        """Range of each key, and whether the key is the first of its range."""
        ids, hashes, at = ~ids.to_numpy(), hashes.to_numpy(), np.empty(len(ids), np.int64)
        for flag in (False, True):  # null ids come last
            own, mine, base = marks[marks.bare == flag], np.flatnonzero(bare == flag), 0 if not flag else int((~marks.bare).sum())
            low, high = (np.searchsorted(own.id.to_numpy(), ids[mine], side) for side in ("left", "right"))
            at[mine] = base + high - 1
            for k in np.flatnonzero(high > low):
                at[mine[k]] = base + low[k] + np.searchsorted(own.hash.to_numpy()[low[k]:high[k]], hashes[mine[k]], "right") - 1
        leads = [k in known for k in zip(bare.tolist(), ids.tolist(), hashes.tolist())]
        return pd.DataFrame({"part": at.astype("int32"), "leads": leads})

    rows = rows.withColumn("_p", place(F.isnull("doc_id"), F.coalesce("doc_id", F.lit(0)), "_h"))
    spots = F.when(F.col("_p.leads"), F.array(
        F.struct(F.col("_p.part").alias("part"), F.lit(False).alias("peek")),
        F.struct(F.when(F.col("_p.part") == 0, last).otherwise(F.col("_p.part") - 1).alias("part"), F.lit(True).alias("peek")),
    )).otherwise(F.array(F.struct(F.col("_p.part").alias("part"), F.lit(False).alias("peek"))))
    rows = rows.select("doc_id", "text", "_h", F.explode(spots).alias("_s")).select("_s.part", "_s.peek", "doc_id", "text", "_h")
    sorted_rows = rows.repartitionById(len(borders), "part").sortWithinPartitions("part", "peek", F.desc_nulls_last("doc_id"), "_h").drop("_h")
    return sorted_rows.mapInArrow(lambda batches: _walk(batches, fraction), schema)


def _walk(batches, fraction):
    """Rows (part, peek, doc_id, text) in order, each with the next of its part; a part ends with rows that only follow."""
    held, size = [], 0

    def done(rows):
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
        texts = [r[3] for r in rows]
        edited = [a[3][:len(a[3]) - len(a[3]) // 2] + b[3][:len(a[3]) // 2] for a, b in pairs]
        hashes, first = sketches(pa.array(texts, pa.large_string()), fraction)
        at = [k for k, (a, b) in enumerate(zip(rows, rows[1:])) if a[0] == b[0] and not a[1]]
        take = lambda places: pa.array([hashes[first[k]:first[k + 1]].view(np.int64) for k in places], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
             pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), take(at),
             _longs(pa.array(edited, pa.large_string()), fraction), take([k + 1 for k in at])],
            names=["doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1] and held and held[-1][:2] == row[:2]:
                continue  # copies of the document that follows a range
            held.append(row)
            size += len(row[3])
            if size > 1 << 18 and len(held) > 1:
                yield done(held)
                held, size = held[-1:], len(row[3])
    if held:
        yield done(held)


def report(found):
    """`beside_next` with the sketches written out and compared."""
    return found.select(
        "doc_id", "n_chars", "edited_sha256", written("sketch").alias("fingerprint"), written("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        contained("sketch", "edited_sketch").alias("contained_in_edited"), contained("sketch", "next_sketch").alias("contained_in_next"))
