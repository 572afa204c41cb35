"""Boosted trees for many targets side by side, with the absolute error as loss.

A target is a column to fit, or the same column on other rows: horizons, folds and strata are targets of one run. All
targets grow a tree at a time, each its own, by passes over one table of binned rows: a pass per level adds up, for each node, column and
bin, the weights and the signs of the residuals; one more pass the residuals of each leaf on a fine grid, whose weighted median is
the value of the leaf. What a pass returns depends on the columns, bins and targets, not on the rows or partitions.

Boosting goes on from the trees it has: the rows keep their predictions, which are written anew every `CYCLE` trees. A target is
done when its error on its stopping rows has not improved for `patience` trees, and keeps its trees up to the best. No number of
trees is fixed beforehand; `most` only bounds a run without stopping rows.
"""
import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F, types as T

from panelcast.sources.files import store

BINS, DEPTH, STEP, PATIENCE, LEAST, CYCLE, SAMPLE = 32, 3, 0.5, 2, 20, 8, 20_000
#: Residuals are counted in cells of 1 / GRID, up to +-REACH (scores are 0 to 5).
GRID, REACH = 200, 6.0
ROWS = 4096


def borders(rows, cols, bins=BINS, sample=SAMPLE):
    """[rising bin borders of each column] from quantiles of about `sample` rows, chosen by a hash of their values.

    A column of one value has none. Null and NaN go to the first bin. The sample bounds what the driver reads; it decides only where
    splits may lie, all rows decide which are taken.
    """
    picked = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    n = picked.count()
    if n > sample:
        picked = picked.filter(F.pmod(F.xxhash64(*picked.columns), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    got = picked.toArrow()
    out = []
    for i in range(len(cols)):
        v = np.asarray(got[f"_{i}"].fill_null(np.nan).combine_chunks()) if len(got) else np.zeros(0)
        v = np.sort(v[~np.isnan(v)])
        out.append(np.unique(v[(np.arange(1, bins) * len(v)) // bins]) if len(v) else v)
    return out


def _matrix(batch, names, fill):
    out = np.empty((batch.num_rows, len(names)))
    for i, c in enumerate(names):
        column = batch.column(c)
        out[:, i] = np.asarray(column.fill_null(fill) if column.null_count else column)
    return out


def _binned(batch, names, cuts):
    out = np.zeros((batch.num_rows, len(names)), np.uint8)
    for i, (c, cut) in enumerate(zip(names, cuts)):
        column = batch.column(c)
        value = np.asarray(column.fill_null(np.nan) if column.null_count else column)
        out[:, i] = np.where(np.isnan(value), 0, np.searchsorted(cut, value, "left") + 1)
    return out


def _array(x):
    """Row-wise list column of a matrix."""
    flat = np.ascontiguousarray(x).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (len(flat) // max(len(x), 1))), pa.array(flat))


def table(rows, cols, fit, stop, weights, cuts):
    """Blocks of rows: bins, targets to fit, targets to stop on (NaN where a row has no part in a target), weights, predictions."""
    x, y, s, w = ([f"_{k}{i}" for i in range(len(c))] for k, c in (("x", cols), ("y", fit), ("s", stop), ("w", weights)))
    picked = rows.select(*[F.col(c).cast("double").alias(n) for c, n in zip([*cols, *fit, *stop, *weights], [*x, *y, *s, *w])])

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                b = whole.slice(low, ROWS)
                target, held = _matrix(b, y, np.nan), _matrix(b, s, np.nan) if s else np.full((b.num_rows, len(y)), np.nan)
                weight = _matrix(b, w, 0.0) if w else np.ones((b.num_rows, len(y)))
                yield pa.RecordBatch.from_arrays([pa.array([_binned(b, x, cuts).tobytes()]), *[_array(m.reshape(1, -1)) for m in (
                    target, held, weight, np.zeros(target.shape))]], names=["bins", "y", "s", "w", "pred"])
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = picked.repartition(parts).mapInArrow(run, "bins binary, y array<double>, s array<double>, w array<double>, pred array<double>")
    return store(blocks, "binned")


class Tree:
    """Splits of a full tree by level: column and bin of each inner node (column -1: all to the left), values of the leaves."""

    def __init__(self, depth):
        self.column, self.bin = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
        self.value, self.gain = np.zeros(1 << depth), np.zeros((1 << depth) - 1)
        self.depth = depth

    def place(self, bins, depth=None):
        """Node of each row on the level `depth`, numbered from 0."""
        at = np.zeros(len(bins), np.int64)
        for level in range(self.depth if depth is None else depth):
            node = (1 << level) - 1 + at
            column = self.column[node]
            right = (bins[np.arange(len(bins)), np.maximum(column, 0)] > self.bin[node]) & (column >= 0)
            at = 2 * at + right
        return at

    def predict(self, bins):
        return self.value[self.place(bins)]


def _blocks(batches, columns, targets, trees):
    """(bins, fit, stop, weight, prediction) matrices of each block, the trees since the last written predictions added."""
    for batch in batches:
        for b in range(batch.num_rows):
            y, s, w, pred = (np.asarray(batch.column(k)[b].values).reshape(-1, targets) for k in ("y", "s", "w", "pred"))
            bins = np.frombuffer(batch.column("bins")[b].as_py(), np.uint8).reshape(-1, columns)
            pred = pred.copy()
            for grown in trees:
                for h, tree in enumerate(grown):
                    if tree is not None:
                        pred[:, h] += tree.predict(bins)
            yield bins, y, s, w, pred


def _level(batches, columns, targets, trees, growing, level, bins_):
    """(target, node) with weights, signs and rows by column and bin; on the first level also (target, -1): error and weight of the stopping rows."""
    size = 1 << level
    total = np.zeros((targets, size, columns, 3, bins_))
    stop = np.zeros((targets, 2))
    offset = np.arange(columns) * bins_
    for bins, y, s, w, pred in _blocks(batches, columns, targets, trees):
        for h in range(targets):
            if growing[h] is None:
                continue
            if level == 0:
                held = ~np.isnan(s[:, h])
                stop[h] += (np.abs(np.clip(pred[held, h], 0, 5) - s[held, h]) * w[held, h]).sum(), w[held, h].sum()
            use = np.flatnonzero(~np.isnan(y[:, h]) & (w[:, h] > 0))
            node = growing[h].place(bins[use], level)
            cell = ((node * columns * bins_)[:, None] + offset + bins[use]).ravel()
            weight = w[use, h]
            sign = np.sign(y[use, h] - pred[use, h]) * weight
            for k, v in enumerate((weight, sign, np.ones(len(use)))):
                total[h, :, :, k] += np.bincount(cell, np.repeat(v, columns), minlength=size * columns * bins_).reshape(size, columns, bins_)
    # few rows of long vectors: the shuffle adds them up by target and node
    rows = [(h, node, total[h, node].ravel()) for h in range(targets) if growing[h] is not None for node in range(size)]
    if level == 0:
        rows += [(h, -1, stop[h]) for h in range(targets) if growing[h] is not None]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["h", "node", "v"])


def _leaves(batches, columns, targets, trees, growing):
    """(target, leaf, cell of the residual): summed weights."""
    width, leaves = int(2 * REACH * GRID) + 1, 1 << growing[next(h for h in range(targets) if growing[h] is not None)].depth
    total = {}
    for bins, y, s, w, pred in _blocks(batches, columns, targets, trees):
        for h in range(targets):
            if growing[h] is None:
                continue
            use = np.flatnonzero(~np.isnan(y[:, h]) & (w[:, h] > 0))
            cell = np.rint((np.clip(y[use, h] - pred[use, h], -REACH, REACH) + REACH) * GRID).astype(np.int64)
            key = growing[h].place(bins[use]) * width + cell
            total[h] = total.get(h, 0) + np.bincount(key, w[use, h], minlength=leaves * width)
    for h, v in total.items():
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), h)), pa.array(some // width), pa.array(some % width), pa.array(v[some])], names=["h", "leaf", "cell", "w"])


def _split(sums, least):
    """(column, bin, gain) of the best split of a node from its (column x 3 x bin) sums; column -1 if none."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    whole = sums.sum(2)[:, :, None]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 1]**2 / left[:, 0] + right[:, 1]**2 / right[:, 0] - whole[:, 1]**2 / whole[:, 0]
    gain = np.where((left[:, 2] >= least) & (right[:, 2] >= least), np.nan_to_num(gain), 0.0)
    gain = np.round(gain, 9)  # sums differ in their last digits with the order of the parts
    best = int(gain.argmax())
    column, at = divmod(best, gain.shape[1])
    return (column, at, gain.flat[best]) if gain.flat[best] > 1e-9 else (-1, 0, 0.0)


class Model:
    """Trees of each target, their bin borders, the errors on the stopping rows by number of trees."""

    def __init__(self, cols, cuts, trees, errors):
        self.cols, self.cuts, self.trees, self.errors = cols, cuts, trees, errors

    def importance(self, targets=None):
        """{column: share of the gain}, the mean over the targets."""
        out = np.zeros(len(self.cols))
        chosen = [self.trees[h] for h in (range(len(self.trees)) if targets is None else targets)]
        for trees in chosen:
            own = np.zeros(len(self.cols))
            for t in trees:
                np.add.at(own, t.column[t.column >= 0], t.gain[t.column >= 0])
            out += own / max(own.sum(), 1e-300) / max(len(chosen), 1)
        return dict(zip(self.cols, out.tolist()))


def boost(rows, cols, fit, stop=(), weights=(), depth=DEPTH, step=STEP, patience=PATIENCE, least=LEAST, most=60, bins=BINS):
    """Model of the target columns `fit` (null: no part in it), stopped by the columns `stop`, weighted by the columns `weights`.

    The first tree is a single leaf, the weighted median. A target without stopping rows grows `most` trees.
    """
    cuts, targets = borders(rows, cols, bins), len(fit)
    data = table(rows, cols, fit, stop, weights, cuts)
    spark, columns, width = rows.sparkSession, len(cols), bins + 1
    trees, errors, fresh = [[] for _ in fit], [[] for _ in fit], []
    live = [True] * targets
    while any(live):
        growing = [Tree(depth) if live[h] else None for h in range(targets)]
        first = not any(trees)
        for level in range(depth):
            sent = spark.sparkContext.broadcast((list(fresh), growing))
            sums = data.mapInArrow(lambda b, level=level, sent=sent: _level(b, columns, targets, *sent.value, level, width), "h long, node long, v array<double>")
            sums = sums.groupBy("h", "node").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("h", "node", vector_to_array("v").alias("v")).toArrow()
            found = {}
            for h, node, v in zip(sums["h"].to_pylist(), sums["node"].to_pylist(), sums["v"]):
                v = np.asarray(v.values)
                if node >= 0:
                    found[h, node] = v.reshape(columns, 3, width)
                elif v[1] > 0:
                    errors[h].append(v[0] / v[1])
            if level == 0:
                for h in range(targets):  # errors[h][k]: with k trees
                    best = int(np.argmin(errors[h])) if errors[h] else 0
                    if live[h] and (len(trees[h]) - best >= patience if errors[h] else len(trees[h]) >= most):
                        live[h], growing[h] = False, None
                        trees[h] = trees[h][:best] if errors[h] else trees[h]
                if not any(live):
                    break
            if first:
                break  # the first tree is one leaf
            for (h, node), s in found.items():
                if growing[h] is not None:
                    at = (1 << level) - 1 + node
                    growing[h].column[at], growing[h].bin[at], growing[h].gain[at] = _split(s, least)
        if not any(live):
            break
        sent = spark.sparkContext.broadcast((list(fresh), growing))
        cells = data.mapInArrow(lambda b, sent=sent: _leaves(b, columns, targets, *sent.value), "h long, leaf long, cell long, w double")
        cells = cells.groupBy("h", "leaf", "cell").agg(F.sum("w").alias("w")).orderBy("h", "leaf", "cell").toArrow()
        h_, leaf, cell, w = (np.asarray(cells[c]) for c in ("h", "leaf", "cell", "w"))
        for h in range(targets):
            if growing[h] is None:
                continue
            for k in np.unique(leaf[h_ == h]):
                own = (h_ == h) & (leaf == k)
                half = np.searchsorted(np.cumsum(w[own]), w[own].sum() / 2 - 1e-9)
                growing[h].value[k] = (cell[own][half] / GRID - REACH) * (1.0 if first else step)
            trees[h].append(growing[h])
        fresh.append(growing)
        if len(fresh) >= CYCLE:
            data, fresh = _advanced(data, columns, targets, fresh), []
    return Model(list(cols), cuts, trees, errors)


def _advanced(data, columns, targets, trees):
    """The table with the trees' values added to its predictions."""
    sent = data.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            for k, (*_, pred) in enumerate(_blocks([batch], columns, targets, sent.value)):
                one = batch.slice(k, 1)
                yield one.set_column(4, "pred", _array(pred.reshape(1, -1)))
    return store(data.mapInArrow(run, data.schema), "binned")


def predict(model, rows, keep=(), low=0.0, high=5.0):
    """`keep` and the array `pred` of the targets' predictions."""
    cols = [f"_x{i}" for i in range(len(model.cols))]
    picked = rows.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in zip(model.cols, cols)])
    schema = T.StructType([picked.schema[c] for c in keep] + [T.StructField("pred", T.ArrayType(T.DoubleType()))])
    sent = rows.sparkSession.sparkContext.broadcast((model.cuts, model.trees))

    def run(batches):
        cuts, trees = sent.value
        for batch in batches:
            bins = _binned(batch, cols, cuts)
            out = np.zeros((batch.num_rows, len(trees)))
            for h, own in enumerate(trees):
                for tree in own:
                    out[:, h] += tree.predict(bins)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _array(np.clip(out, low, high)) if len(out) else pa.array([], pa.list_(pa.float64()))], names=schema.names)
    return picked.mapInArrow(run, schema)
