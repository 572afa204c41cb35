"""Quality by importance resampling.

Two generative models over hashed word and word-pair counts: one of all documents (raw), one of the
documents labelled good (target), drawn towards the raw one by a prior of `PRIOR` n-grams. A pair of equal
words counts in one cell, whatever the word. A document's log weight is the sum of log target/raw over its
n-grams, over the square root of their number so that long and short texts compare. The sample is drawn
without replacement by Gumbel top-k: the k documents with the largest log weight + `TEMPERATURE` * Gumbel noise, the noise
being a hash of the document. k follows from the labelled documents that did not train the target model:
it is the number of documents beyond the cut that tells good from bad with the fewest errors.

Raw counts and weights cover every document. Target counts and the cut use a bounded sample of labelled
rows (`samples.LABELLED`). The models have 2**BITS cells, whatever the input.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm import samples, words as W
from panelcast.llm.names import free
from panelcast.sources.files import store

BITS, PRIOR, TEMPERATURE, SEED = 16, 20_000.0, 0.02, 11


def ngrams(data, offsets):
    """Cells of all words and neighbouring word pairs, and the row of each."""
    hashes, first = W.word_hashes(data, offsets, W.WORD_OR_SIGN, lower=True)
    rows = W.row_numbers(first)
    inside = rows[1:] == rows[:-1]
    pairs = W.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pairs = np.where(hashes[:-1] == hashes[1:], np.uint64(0), pairs)[inside]
    cells = np.concatenate((hashes, pairs)) >> np.uint64(64 - BITS)
    return cells.astype(np.int64), np.concatenate((rows, rows[:-1][inside]))


def _counts(batches, labelled, text):
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        at = labelled.find(batch.column(0))
        good = (at >= 0)
        good[good] = (labelled.labels[at[good], 0] == 1) & (labelled.half[at[good]] == 0)
        for low, data, offsets in W.text_pieces(batch.column(1)):
            cells, rows = ngrams(data, offsets)
            raw += np.bincount(cells, minlength=1 << BITS)
            target += np.bincount(cells[good[rows + low]], minlength=1 << BITS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["cell", "raw", "target"])


def fit(docs, labelled, doc_id="doc_id", text="text"):
    """Log target/raw of each cell, as a broadcast array of 2**BITS numbers."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    counts = rows.mapInArrow(lambda b: _counts(b, labelled, text), "cell long, raw long, target long")
    counts = counts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in counts.collect():  # at most 2**BITS rows
        raw[r.cell], target[r.cell] = r.raw, r.target
    share = (raw + 0.5) / (raw + 0.5).sum()
    return np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)


def _weights(batches, ratio, labelled, doc_id, text):
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ids = batch.column(batch.schema.get_field_index(doc_id)).cast(pa.int64())
        weight, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for low, data, offsets in W.text_pieces(column):
            cells, rows = ngrams(data, offsets)
            n = len(offsets) - 1
            count[low:low + n] = np.bincount(rows, minlength=n)
            weight[low:low + n] = np.bincount(rows, ratio[cells], minlength=n) / np.sqrt(np.maximum(count[low:low + n], 1))
        at = labelled.find(ids)
        held = (at >= 0)
        held[held] = labelled.half[at[held]] == 1
        quality = np.where(held, labelled.labels[at, 0] if len(labelled.ids) else 0, 0)
        draw = W.mix(np.asarray(ids.fill_null(0)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        key = weight - TEMPERATURE * np.log(-np.log(uniform))
        new = [pa.array(weight, mask=count == 0), pa.array(key, mask=count == 0), pa.array(quality, mask=~held)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_log_weight", "_draw", "_held"])


def weigh(docs, ratio, labelled, doc_id="doc_id", text="text"):
    """`docs` with `_log_weight`, `_draw` (the noisy weight) and `_held` (quality of held-out labelled rows)."""
    held = docs.sparkSession.sparkContext.broadcast((ratio, labelled))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(lambda b: _weights(b, *held.value, doc_id, text), ", ".join(fields) + ", _log_weight double, _draw double, _held long")


def best_cut(keys, good, highest=False):
    """The key that separates good rows (at or above) from bad with the fewest errors, midway between two rows.

    Of equal cuts the lowest, or the highest.
    """
    order = np.argsort(keys, kind="stable")
    keys, good = keys[order], good[order].astype(bool)
    if not good.any() or good.all():
        return -np.inf
    errors = np.concatenate(([0], np.cumsum(good))) + np.concatenate((np.cumsum(~good[::-1])[::-1], [0]))
    # a cut lies between different keys only
    errors[1:-1] = np.where(keys[1:] > keys[:-1], errors[1:-1], len(keys) + 1)
    best = int(np.flatnonzero(errors == errors.min())[-1 if highest else 0])
    if best == 0:
        return -np.inf
    return keys[-1] + 1.0 if best == len(keys) else (keys[best - 1] + keys[best]) / 2


def border(drawn, k, column="_draw", most=5000):
    """The k-th largest value of a column, found by counting in ever finer ranges; None for k < 1 or no rows.

    With fewer than k rows it is the least value.
    """
    if k < 1:
        return None
    low, high, above = *drawn.agg(F.min(column), F.max(column)).first(), 0
    if low is None:
        return None
    while True:
        inside = drawn.filter(F.col(column).between(low, high))
        step = (high - low) / 1024
        place = F.least(F.floor((F.col(column) - low) / step), F.lit(1023)) if step > 0 else F.lit(0)
        counts = sorted(((r.p, r.n, r.a, r.b) for r in inside.groupBy(place.alias("p")).agg(
            F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()), reverse=True)
        for p, n, a, b in counts:
            if above + n >= k:
                break
            above += n
        else:
            return low
        if a == b:
            return a
        if n <= most:
            got = sorted((r[0] for r in inside.filter(F.col(column).between(a, b)).select(column).collect()), reverse=True)
            return got[k - above - 1]
        low, high = a, b


def _cut(docs, labels, doc_id, text):
    """(docs with weights, least draw that is kept)."""
    labelled = samples.sample(labels, ["quality"])
    ratio = fit(docs, labelled, doc_id, text)
    narrow = docs.select(F.col(doc_id), F.col(text))
    drawn = store(weigh(narrow, ratio, labelled, doc_id, text).drop(text), "weights")
    held = np.array([(r._draw, r._held) for r in drawn.filter("_held IS NOT NULL AND _draw IS NOT NULL").select("_draw", "_held").collect()]).reshape(-1, 2)
    cut = best_cut(held[:, 0], held[:, 1])
    k = drawn.filter(F.col("_draw") >= float(cut)).count()
    return drawn, ratio, labelled, border(drawn, k)


def _kept(least):
    return F.lit(False) if least is None else F.coalesce(F.col("_draw") >= F.lit(float(least)), F.lit(False))


def classify(docs, labels, doc_id="doc_id", text="text"):
    """One row per row of `docs`: doc_id, log_weight and kept.

    Documents without words have no weight and are never drawn. Rows that repeat an id share their noise;
    rows that tie with the last one drawn are drawn too. Without labelled rows of both kinds all
    documents with words are kept.
    """
    drawn, _, _, least = _cut(docs, labels, doc_id, text)
    return drawn.select(F.col(doc_id).alias("doc_id"), F.col("_log_weight").alias("log_weight"), _kept(least).alias("kept"))


def keep(docs, labels, doc_id="doc_id", text="text"):
    """The rows of `docs` that are drawn, with all their columns."""
    _, ratio, labelled, least = _cut(docs, labels, doc_id, text)
    # columns of these names would hide the weights
    hidden = {c: free(docs, c) for c in ("_log_weight", "_draw", "_held") if c in docs.columns}
    rows = weigh(docs.withColumnsRenamed(hidden), ratio, labelled, doc_id, text).filter(_kept(least))
    return rows.drop("_log_weight", "_draw", "_held").withColumnsRenamed({v: c for c, v in hidden.items()})
