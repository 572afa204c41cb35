"""Linear decomposition models: trend and season of a window of weeks, mapped to several horizons.

A member k splits every channel of a window into a moving average of its kernel (the trend, borders repeated) and the
rest (the season); a horizon's prediction is linear in both, plus side columns and a term of the region. All members
and horizons are fitted together, each with the mean Huber loss and a ridge penalty, by L-BFGS.

Splitting is linear too, so trend and season never have to be made: a member's weights on both become one weight per
channel and week (`combined`), and the gradient on both comes from that on the window (`split_gradient`). A region's weeks
are stored once, in blocks of `WEEK_CHUNK` anchors with the weeks before them; tasks cut windows out of a block, a hundred
anchors at a time. A step is one pass over the blocks that returns losses and gradients of all members and horizons, summed by
the shuffle: vectors as long as the weights, whatever the number of anchors or partitions.

The term of a region starts at its mean target and moves, between the rounds, by its mean bounded residual
(a step that can't raise the Huber loss). It is a column of a table, so the number of regions is not bounded by the driver.
"""
import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from panelcast.config import KEY, WEEK, WEEK_CHUNK
from panelcast.functions.chunks import CHUNK, OWN, chunked
from panelcast.sources.files import store

DELTA, RIDGE, ROUNDS, STEPS, MEMORY = 1.35, 0.01, 3, 14, 10
ROWS, PIECES = 128, 16


def blocks(weeks, anchors, channels, side, targets, length, keep=("part",), size=WEEK_CHUNK):
    """One row per region and run of `size` weeks: the matrix of its weeks and the `length - 1` before them, row by row, and of its
    anchors their weeks, side columns and targets. A block holds at most size + length - 1 weeks.

    Null channels and side columns count as 0, null targets are no targets.
    """
    value = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in channels])
    cut = chunked(weeks.select(KEY, WEEK, value.alias("x")), WEEK, size, before=length - 1)
    week = F.struct(WEEK, OWN, "x")
    matrix = cut.groupBy(KEY, CHUNK).agg(F.array_sort(F.collect_list(week)).alias("w")).filter(F.exists("w", lambda w: w[OWN]))
    extra = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in side]) if side else F.array().cast("array<double>")
    truth = F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(float("nan"))) for t in targets]).cast("array<double>")
    own = anchors.select(KEY, F.floor(F.col(WEEK) / size).alias(CHUNK), F.struct(
        F.col(WEEK).alias("at"), *keep, extra.alias("side"), truth.alias("truth")).alias("a"))
    rows = own.groupBy(KEY, CHUNK).agg(F.array_sort(F.collect_list("a")).alias("a")).join(matrix, [KEY, CHUNK])
    return rows.select(
        KEY, F.col(CHUNK).alias("chunk"), F.transform("w", lambda w: w[WEEK]).alias("weeks"), F.flatten(F.transform("w", lambda w: w["x"])).alias("x"),
        F.transform("a", lambda a: a["at"]).alias("at"), *[F.col("a").getField(c).alias(c) for c in keep],
        F.flatten(F.transform("a", lambda a: a["side"])).alias("side"), F.flatten(F.transform("a", lambda a: a["truth"])).alias("truth"))


def averaging(length, kernel):
    """Matrix whose product with a window of weeks is its trend."""
    front, end = (kernel - 1) // 2, kernel // 2
    out = np.zeros((length, length))
    for i in range(length):
        np.add.at(out[i], np.clip(np.arange(i - front, i + end + 1), 0, length - 1), 1 / kernel)
    return out


class Shape:
    """Layout of the weights: for each problem (member, horizon) trend and season by channel and week, side columns, intercept."""

    def __init__(self, channels, length, kernels, side, horizons):
        self.channels, self.length, self.kernels, self.side, self.horizons = channels, length, tuple(kernels), side, horizons
        self.trends = [averaging(length, k) for k in kernels]
        self.part, self.problems = channels * length, len(kernels) * horizons
        self.size = 2 * self.part + side + 1

    def combined(self, weights):
        """(window, side and intercept) x problem."""
        out = np.zeros((self.part + self.side + 1, self.problems))
        for j in range(self.problems):
            a, w = self.trends[j // self.horizons], weights[j]
            trend, season = (w[i * self.part:(i + 1) * self.part].reshape(self.channels, self.length) for i in (0, 1))
            out[:self.part, j] = (season + (trend - season) @ a).T.ravel()
            out[self.part:, j] = w[2 * self.part:]
        return out

    def split_gradient(self, gradient):
        """Gradient on the weights, from the one on `combined`."""
        out = np.zeros((self.problems, self.size))
        for j in range(self.problems):
            a, g = self.trends[j // self.horizons], gradient[:self.part, j].reshape(self.length, self.channels).T
            trend = g @ a.T
            out[j] = np.concatenate((trend.ravel(), (g - trend).ravel(), gradient[self.part:, j]))
        return out


def _lists(column):
    return np.asarray(column.offsets), np.asarray(column.flatten())


def windows(batch, length, channels, horizons, side):
    """For each block, `ROWS` anchors at a time: (row of the batch, anchors, windows and side columns with a 1, targets).

    A window is the last `length` weeks up to the anchor, week by week, its first week repeated in front where there are fewer.
    """
    (week_at, weeks), (at_at, at) = _lists(batch.column("weeks")), _lists(batch.column("at"))
    x, extra, truth = (np.asarray(batch.column(c).flatten()) for c in ("x", "side", "truth"))
    week_at, at_at = week_at - week_at[0], at_at - at_at[0]
    x, extra, truth = x.reshape(-1, channels), extra.reshape(len(at), side), truth.reshape(len(at), horizons)
    for b in range(len(batch)):
        own = x[week_at[b]:week_at[b + 1]]
        padded = np.concatenate((np.repeat(own[:1], length - 1, 0), own))
        every = np.lib.stride_tricks.sliding_window_view(padded, length, axis=0)  # ends at week i
        place = np.searchsorted(weeks[week_at[b]:week_at[b + 1]], at[at_at[b]:at_at[b + 1]])
        for low in range(0, len(place), ROWS):
            some = slice(at_at[b] + low, min(at_at[b] + low + ROWS, at_at[b + 1]))
            flat = every[place[low:low + ROWS]].transpose(0, 2, 1).reshape(some.stop - some.start, -1)
            yield b, some, np.concatenate((flat, extra[some], np.ones((len(flat), 1))), 1), truth[some]


def _offsets(batch, shape):
    return np.asarray(batch.column("offset").flatten()).reshape(len(batch), shape.problems)


def _pass(batches, shape, weights, delta):
    """Summed Huber loss, its gradient on `combined` and the number of targets, as `PIECES` pieces of one vector."""
    gradient, loss, seen = np.zeros((shape.part + shape.side + 1, shape.problems)), np.zeros(shape.problems), np.zeros(shape.problems)
    for batch in batches:
        offsets = _offsets(batch, shape)
        fitted = [np.asarray(batch.column("part").flatten().to_pylist()) == "train"]
        for b, some, x, truth in windows(batch, shape.length, shape.channels, shape.horizons, shape.side):
            use = fitted[0][some]
            x, truth = x[use], np.tile(truth[use], len(shape.kernels))
            r = x @ weights + offsets[b] - truth
            known = ~np.isnan(r)
            r = np.where(known, r, 0.0)
            bounded = np.clip(r, -delta, delta)
            gradient += x.T @ bounded
            loss += (bounded * (r - bounded / 2)).sum(0)
            seen += known.sum(0)
    rows = np.concatenate((gradient, loss[None], seen[None])).ravel()
    pieces = np.array_split(rows, PIECES)  # few rows of long vectors
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES)), pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pieces]))), pa.int32()), pa.array(rows))], names=["i", "v"])


def evaluated(rows, shape, weights, delta=DELTA, ridge=RIDGE):
    """(objective, gradient) of each problem at `weights`, from one pass over the blocks."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(shape.combined(weights))
    sums = rows.mapInArrow(lambda b: _pass(b, shape, sent.value, delta), "i long, v array<double>")
    sums = sums.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", vector_to_array("v").alias("v")).toArrow()
    got = np.zeros((shape.part + shape.side + 3, shape.problems))
    if len(sums):
        pieces = dict(zip(sums["i"].to_pylist(), (np.asarray(v.values) for v in sums["v"])))
        got = np.concatenate([pieces[k] for k in range(PIECES)]).reshape(got.shape)
    sent.destroy()
    n = np.maximum(got[-1], 1.0)
    penalty = weights.copy()
    penalty[:, -1] = 0.0
    loss = got[-2] / n + ridge / 2 * (penalty**2).sum(1)
    return loss, shape.split_gradient(got[:-2] / n) + ridge * penalty


def minimised(evaluate, start, steps, memory=MEMORY, tolerance=1e-7):
    """L-BFGS on many problems side by side: (problems x size) weights after at most `steps` evaluations.

    Every evaluation serves all problems; one whose step doesn't lower its objective halves the step while the others go on.
    """
    at, (value, slope) = start, evaluate(start)
    pairs, length = [], 1.0 / np.maximum(np.abs(slope).sum(1), 1e-12)
    first, step = np.ones(len(at), bool), np.minimum(1.0, length)
    direction = -slope
    for _ in range(steps):
        trial = at + step[:, None] * direction
        new, g = evaluate(trial)
        down = (direction * slope).sum(1)
        taken = new <= value + 1e-4 * step * down
        s, y = np.where(taken[:, None], trial - at, 0.0), np.where(taken[:, None], g - slope, 0.0)
        pairs = [*pairs[-(memory - 1):], (s, y, (s * y).sum(1))]
        at, value, slope = np.where(taken[:, None], trial, at), np.where(taken, new, value), np.where(taken[:, None], g, slope)
        first &= ~taken
        turned = -_two_loops(pairs, slope)
        turned[first] = -slope[first]
        direction = np.where(taken[:, None], turned, direction)
        step = np.where(taken, 1.0, step / 2)
        if np.abs(slope).max() < tolerance:
            break
    return at, value


def _two_loops(pairs, slope):
    """Inverse Hessian estimate times the gradient; a pair of a step not taken or without curvature has no part in its problem."""
    q, kept, scale = slope.copy(), [], np.ones(len(slope))
    for s, y, sy in reversed(pairs):
        good = sy > 1e-14
        rho = np.where(good, 1 / np.where(good, sy, 1.0), 0.0)
        a = rho * (s * q).sum(1)
        q -= a[:, None] * y
        kept.append((s, y, rho, a))
    for s, y, sy in pairs:
        yy = (y * y).sum(1)
        scale = np.where((sy > 1e-14) & (yy > 0), sy / np.where(yy > 0, yy, 1.0), scale)
    q *= scale[:, None]
    for s, y, rho, a in reversed(kept):
        q += (a - rho * (y * q).sum(1))[:, None] * s
    return q


def _scored(batches, shape, weights, outputs, keep):
    """Each anchor with its predictions: the mean of the members for each horizon, or all problems with `outputs` = problems."""
    for batch in batches:
        offsets, at = _offsets(batch, shape), np.asarray(batch.column("at").flatten())
        for b, some, x, _ in windows(batch, shape.length, shape.channels, shape.horizons, shape.side):
            p = x @ weights + offsets[b]
            if outputs == shape.horizons:
                p = p.reshape(len(x), -1, shape.horizons).mean(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(KEY)[b].as_py()] * len(x), pa.string()), pa.array(at[some]),
                 *[batch.column(c).flatten().slice(some.start, len(x)) for c in keep],
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * outputs, pa.int32()), pa.array(p.ravel()))],
                names=[KEY, WEEK, *keep, "pred"])


def predicted(rows, shape, weights, keep=("part",), members=False):
    """(region, week, `keep`, pred): mean prediction of the members for each horizon, or that of each member and horizon."""
    sent = rows.sparkSession.sparkContext.broadcast(shape.combined(weights))
    outputs = shape.problems if members else shape.horizons
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.elementType.simpleString()}" for c in keep)
    schema = f"{KEY} string, {WEEK} long, {kinds + ', ' if kinds else ''}pred array<double>"
    return rows.mapInArrow(lambda b: _scored(b, shape, sent.value, outputs, keep), schema)


def _bounded(batches, shape, weights, delta):
    """Per block and problem the sum of bounded residuals and the number of targets."""
    for batch in batches:
        total = np.zeros((len(batch), 2 * shape.problems))
        offsets, part = _offsets(batch, shape), np.asarray(batch.column("part").flatten().to_pylist())
        for b, some, x, truth in windows(batch, shape.length, shape.channels, shape.horizons, shape.side):
            r = np.tile(truth, len(shape.kernels)) - x @ weights - offsets[b]
            r[part[some] != "train"] = np.nan
            total[b] += np.concatenate((np.nansum(np.clip(r, -delta, delta), 0), (~np.isnan(r)).sum(0)))
        yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.ListArray.from_arrays(
            pa.array(np.arange(len(batch) + 1) * total.shape[1], pa.int32()), pa.array(total.ravel()))], names=[KEY, "v"])


def region_steps(rows, shape, weights, delta=DELTA):
    """(region, step): the mean bounded residual of each problem over a region's fitted anchors, one extra anchor counted as 0."""
    sent = rows.sparkSession.sparkContext.broadcast(shape.combined(weights))
    sums = rows.mapInArrow(lambda b: _bounded(b, shape, sent.value, delta), f"{KEY} string, v array<double>")
    sums = sums.groupBy(KEY).agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return sums.select(KEY, F.expr(f"transform(slice(v, 1, {shape.problems}), (x, i) -> x / (v[i + {shape.problems}] + 1))").alias("step"))


def with_first_offsets(rows, shape):
    """Column `offset`: the mean target of each region's fitted anchors, the mean of all regions where there is none."""
    pairs = F.arrays_zip(F.expr(f"transform(sequence(0, size(truth) - 1), i -> i % {shape.horizons})").alias("h"), F.expr(
        f"transform(sequence(0, size(truth) - 1), i -> part[int(i / {shape.horizons})])").alias("p"), F.col("truth").alias("y"))
    one = rows.select(KEY, F.explode(pairs).alias("t")).filter("t.p = 'train' AND NOT isnan(t.y)").select(KEY, "t.h", "t.y")
    whole = one.groupBy("h").agg(F.avg("y").alias("m")).collect()
    mean = F.array(*[F.lit(float(next((r.m for r in whole if r.h == h), 0.0))) for h in range(shape.horizons)])
    own = one.groupBy(KEY).pivot("h", list(range(shape.horizons))).avg("y")
    own = own.select(KEY, F.array(*[F.col(str(h)) for h in range(shape.horizons)]).alias("own"))
    level = F.transform(mean, lambda m, h: F.coalesce(F.get(F.col("own"), h), m))
    return rows.join(own, KEY, "left").withColumn("offset", F.flatten(F.array_repeat(level, len(shape.kernels)))).drop("own")


def _spread(rows):
    """As many parts as there are cores or shuffle partitions: a block is small, the work on it is not."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), KEY, "chunk")


def fit(rows, shape, rounds=ROUNDS, steps=STEPS, delta=DELTA, ridge=RIDGE):
    """(blocks with the regions' terms, weights, objectives by round), fitted on the anchors of part `train`."""
    rows = store(_spread(with_first_offsets(rows, shape)), "sequence-blocks")
    weights, values = np.zeros((shape.problems, shape.size)), []
    for left in reversed(range(rounds)):
        weights, value = minimised(lambda w: evaluated(rows, shape, w, delta, ridge), weights, steps)
        values.append(value)
        if left:
            moved = rows.join(region_steps(rows, shape, weights, delta), KEY, "left")
            new = F.when(F.col("step").isNull(), F.col("offset")).otherwise(F.zip_with("offset", "step", lambda a, b: a + b))
            rows = store(_spread(moved.withColumn("offset", new).drop("step")), "sequence-blocks")
    return rows, weights, values
