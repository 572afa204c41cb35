"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models over the words that stand in a
text. Each model also sees the probabilities of the categories before it. In training those are
out-of-fold: a document's probability comes from a model that has not seen the document, so later
models learn from probabilities as good as those they get when scoring.

Models are fitted on a bounded sample of labelled documents (`samples.LABELLED`), one task for each fold
and one for the whole sample; every document is scored. A category is said to hold from the probability on
that separates the out-of-fold rows with the fewest errors.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm import samples, words as W
from panelcast.llm.resampling import best_cut
from panelcast.sources.files import store

BITS, CHOSEN, FOLDS, RIDGE, STEPS = 20, 2048, 4, 0.5, 200


def features(data, offsets):
    """Cells of the distinct words of each row, and row borders."""
    hashes, first = W.word_hashes(data, offsets, W.WORD_OR_SIGN, lower=True)
    code = W.row_numbers(first) << BITS | (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    code = np.unique(code)
    rows = code >> BITS
    return code & ((1 << BITS) - 1), np.searchsorted(rows, np.arange(len(first)))


def _sampled(batches, labelled):
    for batch in batches:
        at = labelled.find(batch.column(0))
        own = np.flatnonzero(at >= 0)
        texts = batch.column(1).take(pa.array(own))
        for low, data, offsets in W.text_pieces(texts):
            cells, first = features(data, offsets)
            rows = own[low:low + len(first) - 1]
            flat = labelled.labels[at[rows]]
            labels = W.lists(flat.ravel(), np.arange(len(rows) + 1) * flat.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), labels, W.lists(cells, first, pa.int32())], names=["id", "labels", "cells"])


class Chosen:
    """The cells that tell a category best, and a weight for each."""

    def __init__(self, cells, rows, y):
        n, positive = len(y), max(1, int(y.sum()))
        seen = np.bincount(cells, minlength=1 << BITS)
        hit = np.bincount(cells[y[rows] == 1], minlength=1 << BITS)
        expected = seen * positive / max(1, n)
        score = np.where(seen >= 3, np.abs(hit - expected) / np.sqrt(expected + 1), 0)
        best = np.argsort(-score, kind="stable")[:CHOSEN]
        self.cells = np.sort(best[score[best] > 0])


def _design(cells, rows, chosen):
    at = np.searchsorted(chosen, cells)
    at = np.minimum(at, max(0, len(chosen) - 1))
    ok = chosen[at] == cells if len(chosen) else np.zeros(len(cells), bool)
    return at[ok], rows[ok]


def fit(cells, rows, extra, y):
    """Logistic regression by accelerated gradient steps: (cells, weights, weights of `extra`, intercept)."""
    n = len(y)
    base = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if n == 0 or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(extra.shape[1]), base
    chosen = Chosen(cells, rows, y).cells
    col, row = _design(cells, rows, chosen)
    d, extras = len(chosen), extra.shape[1]
    size = np.sqrt(np.bincount(col, minlength=d) + 1.0)  # scale columns alike: rare words learn as fast
    value = 1.0 / size[col]
    w = np.zeros(d + extras + 1)
    w[-1] = base
    per_row = np.bincount(row, value, minlength=n) + np.abs(extra).sum(axis=1) + 1
    per_col = np.bincount(col, value * per_row[row], minlength=d)
    largest = max(per_col.max(initial=0), (np.abs(extra) * per_row[:, None]).sum(axis=0).max(initial=0), per_row.sum())
    rate = 1 / (0.25 * largest + RIDGE)
    ridge = np.concatenate((RIDGE / size**2, np.full(extras, RIDGE / n), [0.0]))
    # separate step sizes keep the dense columns from slowing the sparse ones
    rates = np.concatenate((1 / (0.25 * per_col + ridge[:d] + 1e-9), np.full(extras + 1, rate)))
    ahead, momentum = w.copy(), 1.0
    for _ in range(STEPS):
        z = np.bincount(row, value * ahead[col], minlength=n) + extra @ ahead[d:d + extras] + ahead[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gradient = np.concatenate((np.bincount(col, value * r[row], minlength=d), extra.T @ r, [r.sum()])) + ridge * ahead
        new = ahead - rates * gradient
        later = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / later * (new - w), new, later
    return chosen, w[:d] / size, w[d:d + extras], w[-1]


def predict(model, cells, rows, extra):
    chosen, weights, more, base = model
    col, row = _design(cells, rows, chosen)
    z = np.bincount(row, weights[col], minlength=len(extra)) + extra @ more + base
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fold(category):
    def run(table):
        """One fold's model: probabilities of the rows outside it, or the model itself for the whole sample."""
        fold = table["model"][0].as_py()
        own = np.asarray(table["fold"]) == fold
        cells = table["cells"].combine_chunks()
        lengths = np.asarray(cells.value_lengths())
        flat, row = np.asarray(cells.flatten()).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
        y = np.array([x[category] for x in table["labels"].to_pylist()])
        extra = np.array(table["earlier"].to_pylist(), np.float64).reshape(len(y), category)
        train = np.flatnonzero(~own)
        place = np.full(len(y), -1)
        place[train] = np.arange(len(train))
        use = place[row] >= 0
        model = fit(flat[use], place[row[use]], extra[train], y[train])
        if fold < 0:
            parts = [np.asarray(x, "<f8").tobytes() for x in model]
            return pa.table([pa.array([None], pa.int64()), pa.array([None], pa.float64())] + [pa.array([p], pa.binary()) for p in parts],
                            names=["id", "p", "cells", "weights", "earlier", "base"])
        held = np.flatnonzero(own)
        place[:] = -1
        place[held] = np.arange(len(held))
        use = place[row] >= 0
        p = predict(model, flat[use], place[row[use]], extra[held])
        nothing = pa.nulls(len(held), pa.binary())
        return pa.table([table["id"].combine_chunks().take(pa.array(held)), pa.array(p)] + [nothing] * 4, names=["id", "p", "cells", "weights", "earlier", "base"])
    return run


def train(docs, labels, categories, doc_id="doc_id", text="text"):
    """[(model, cut)] per category; `categories` are columns of `labels` with 0 and 1."""
    labelled = samples.sample(labels, categories, doc_id)
    held = docs.sparkSession.sparkContext.broadcast(labelled)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.mapInArrow(lambda b: _sampled(b, held.value), "id long, labels array<long>, cells array<int>").dropDuplicates(["id"])
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(FOLDS)).cast("int"))
    rows = store(rows.withColumn("earlier", F.array().cast("array<double>")), "labelled")
    chain = []
    for k, _ in enumerate(categories):
        models = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(-1, FOLDS)])))
        fitted = store(models.groupBy("model").applyInArrow(_fold(k), "id long, p double, cells binary, weights binary, earlier binary, base binary"), "models")
        whole = fitted.filter("base IS NOT NULL").first()
        if whole is None:  # no labelled document at all
            return []
        model = tuple(np.frombuffer(whole[c], "<f8") for c in ("cells", "weights", "earlier", "base"))
        model = model[0].astype(np.int64), model[1], model[2], float(model[3][0])
        rows = store(rows.join(fitted.filter("base IS NULL").select("id", "p"), "id").withColumn(
            "earlier", F.concat("earlier", F.array("p"))).drop("p"), "labelled")
        seen = np.array([(r.p, r.y) for r in rows.select(F.col("earlier")[k].alias("p"), F.col("labels")[k].alias("y")).collect()]).reshape(-1, 2)
        both = len(seen) and 0 < seen[:, 1].mean() < 1
        chain.append((model, float(best_cut(seen[:, 0], seen[:, 1], highest=True)) if both else 2.0))
    return chain


def _score(batches, chain, categories):
    for batch in batches:
        p = np.zeros((batch.num_rows, len(categories)))
        for low, data, offsets in W.text_pieces(batch.column(1)):
            cells, first = features(data, offsets)
            rows, high = W.row_numbers(first), low + len(first) - 1
            for k, (model, _) in enumerate(chain):
                p[low:high, k] = predict(model, cells, rows, p[low:high, :k])
        out = [batch.column(0), *[pa.array(p[:, k]) for k in range(len(categories))]]
        out += [pa.array(p[:, k] >= (chain[k][1] if chain else 2.0)) for k in range(len(categories))]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", *[f"p_{c}" for c in categories], *categories])


def classify(docs, labels, categories=("junk", "toxic"), doc_id="doc_id", text="text"):
    """One row per row of `docs`: doc_id, p_<category> and <category> (boolean) for each category.

    Null texts have no words and get the models' base rates. A category without labelled rows of both
    kinds never holds; without any labelled document all probabilities are 0. Repeated rows are
    scored each.
    """
    categories = list(categories)
    chain = train(docs, labels, categories, doc_id, text)
    held = docs.sparkSession.sparkContext.broadcast(chain)
    fields = ["doc_id bigint", *[f"p_{c} double" for c in categories], *[f"{c} boolean" for c in categories]]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _score(b, held.value, categories), ", ".join(fields))
