"""Alignment, weighting and correction of prediction tables."""
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from panelcast.config import HORIZONS, KEY, WEEK
from panelcast.functions.scalars import clip, corr
from panelcast.sources.files import store

PRED = [f"pred_week{h}" for h in HORIZONS]
# Member shares of the blend and its two published shrink factors.
SHARES = (0.40, 0.35, 0.25)
SHRINK = {"single": 0.975092816675869, "ensemble": 0.9694903458056041}


def weighted_blend(members, shares=SHARES, shrink=1.0):
    """shrink * sum(share * member) of wide prediction tables, for regions all of them have."""
    named = [m.select(KEY, *[F.col(c).alias(f"m{i}_{c}") for c in PRED]) for i, m in enumerate(members)]
    joined = reduce(lambda a, b: a.join(b, KEY), named)
    return joined.select(KEY, *[
        (shrink * sum((s * F.col(f"m{i}_{c}") for i, s in list(enumerate(shares))[1:]), shares[0] * F.col(f"m0_{c}"))).alias(c)
        for c in PRED])


def blend_to_first(members, weights):
    """Weighted sum over the regions of the first table, clipped; weights must sum to 1."""
    if abs(sum(weights) - 1.0) > 1e-4 or len(weights) != len(members):
        raise ValueError("weights must match the members and sum to 1")
    named = [m.select(KEY, *[F.col(c).alias(f"m{i}_{c}") for c in PRED]) for i, m in enumerate(members)]
    joined = reduce(lambda a, b: a.join(b, KEY, "left"), named)
    total = lambda c: reduce(lambda a, b: a + b, [w * F.col(f"m{i}_{c}") for i, w in enumerate(weights)])
    return joined.select(KEY, *[clip(total(c), 0.0, 5.0).alias(c) for c in PRED])


def align(long, names, clusters=None):
    """One row per (region, week, horizon) that every member predicts, with a column per member.

    `truth_mismatch` marks rows on which the members disagree about the truth.
    """
    out = long.groupBy(KEY, WEEK, "horizon").agg(
        *[F.max(F.when(F.col("member") == n, F.col("pred"))).alias(f"p_{n}") for n in names],
        F.max("truth").alias("truth"), (F.max("truth") - F.min("truth") > 1e-3).alias("truth_mismatch"))
    out = out.dropna(subset=[f"p_{n}" for n in names])
    if clusters is None:
        return out.withColumn("cluster_id", F.lit(-1))
    joined = out.join(clusters.select(KEY, "region_cluster_id"), KEY, "left")
    return joined.withColumn("cluster_id", F.coalesce("region_cluster_id", F.lit(-1)).cast("int")).drop("region_cluster_id")


def mean_of_members(long):
    return long.groupBy(KEY, WEEK, "horizon").agg(F.avg("pred").alias("pred"), F.max("truth").alias("truth"))


def distinct_cells(aligned, names):
    """The table as distinct (cluster, horizon, predictions, truth) with their number `times`, all that errors depend on."""
    return aligned.groupBy("cluster_id", "horizon", *[f"p_{n}" for n in names], "truth").agg(F.count("*").alias("times"))


def score_weights(aligned, names, weight_rows, count=None):
    """Cluster-averaged and macro error of every weight row, from one pass over the table.

    `count` names a column with the number of times a row stands for.

    Each row of the table becomes one vector with its error under every weight row; the
    vectors are summed per (cluster, horizon), so the table is never multiplied by the
    number of weight rows.
    """
    columns = [F.lit(np.array([float(w[i]) for w in weight_rows])) for i in range(len(names))]
    table = F.arrays_zip(*[c.alias(n) for c, n in zip(columns, names)])
    times = F.lit(1) if count is None else F.col(count)
    def errors(w):
        blend = reduce(lambda a, b: a + b, [w[n] * F.col(f"p_{n}") for n in names])
        return times * F.abs(blend - F.col("truth"))
    summed = Summarizer.sum(array_to_vector(F.transform(table, errors)))
    cells = aligned.groupBy("cluster_id", "horizon").agg(F.sum(times).alias("n"), summed.alias("s"))
    long = cells.select("cluster_id", "horizon", "n",
                        F.posexplode(vector_to_array("s")).alias("weight_id", "s"))
    per_cluster = long.filter("cluster_id >= 0").groupBy("weight_id", "cluster_id").agg(F.avg(F.col("s") / F.col("n")).alias("m"))
    by_cluster = per_cluster.groupBy("weight_id").agg(F.avg("m").alias("cluster_mae"))
    per_horizon = long.groupBy("weight_id", "horizon").agg((F.sum("s") / F.sum("n")).alias("m"))
    macro = per_horizon.groupBy("weight_id").agg(F.avg("m").alias("macro_mae"))
    out = macro.join(by_cluster, "weight_id", "left")
    return out.withColumn("cluster_mae", F.coalesce("cluster_mae", "macro_mae"))


def simplex_grid(step=20):
    """Weight rows (a, b, c) in steps of 1/step that sum to 1."""
    return [(i / step, j / step, (step - i - j) / step) for i in range(step + 1) for j in range(step + 1 - i)]


def named_weights(spark, names, weight_rows):
    schema = "weight_id int, " + ", ".join(f"w_{n} double" for n in names)
    return spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(weight_rows)], schema)


def grid_search(aligned, names, weight_rows, objective="cluster_mae", top=15):
    scored = score_weights(aligned, names, weight_rows)
    table = named_weights(aligned.sparkSession, names, weight_rows)
    # errors that differ only in the last bits count as equal
    rounded = F.floor(F.col(objective) * 1e9 + 0.5)
    return scored.join(table, "weight_id").orderBy(rounded, "weight_id").limit(top)


def hill_climb(aligned, names, step=0.02, max_steps=200, objective="cluster_mae"):
    """Greedy weights: add the step that lowers the objective most, stop below a gain of 1e-6.

    The table is compacted to its distinct cells once and stored; every step is one aggregation of them that
    scores all members' moves together. Returns the normalised weights and the history
    [(added member, objective)]; without rows the weights are equal and the history is empty.
    """
    cells = store(distinct_cells(aligned, names), "blend_cells")
    weights, best, history = [0.0] * len(names), float("inf"), []
    for _ in range(max_steps):
        total = sum(weights) + step
        moves = [[(w + step * (i == j)) / total for j, w in enumerate(weights)] for i in range(len(names))]
        scores = {r["weight_id"]: r[objective] for r in score_weights(cells, names, moves, "times").collect() if r[objective] is not None}
        if not scores:
            break
        i = min(scores, key=lambda k: (scores[k], k))
        if scores[i] >= best - 1e-6:
            break
        weights[i] += step
        best = scores[i]
        history.append((names[i], best))
    total = sum(weights)
    return [w / total if total else 1 / len(names) for w in weights], history


def member_correlations(aligned, names):
    """Correlation of every pair of members, averaged over the horizons."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    per = aligned.groupBy("horizon").agg(*[corr(f"p_{a}", f"p_{b}").alias(f"c_{a}__{b}") for a, b in pairs])
    one = per.agg(*[F.avg(f"c_{a}__{b}").alias(f"c_{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("member_a"), F.lit(b).alias("member_b"), F.col(f"c_{a}__{b}").alias("corr"))
                     for a, b in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def region_shifts(preds, minimum=8, cap=0.5):
    """Mean residual of regions with enough nonzero weeks, capped; 0 elsewhere."""
    weeks = preds.groupBy(KEY, WEEK).agg(F.max("truth").alias("_top"), F.sum(F.col("pred") - F.col("truth")).alias("_r"),
                                         F.count("*").alias("_n"))
    per = weeks.groupBy(KEY).agg(F.count_if(F.col("_top") > 0).alias("n_nonzero"), (F.sum("_r") / F.sum("_n")).alias("_m"))
    shift = F.when(F.col("n_nonzero") >= minimum, F.least(F.greatest(F.col("_m"), F.lit(-cap)), F.lit(cap))).otherwise(0.0)
    return per.select(KEY, "n_nonzero", shift.alias("shift"))


def apply_shifts(preds, shifts):
    out = preds.join(shifts.select(KEY, "shift"), KEY, "left")
    return out.withColumn("pred", clip(F.col("pred") - F.coalesce("shift", F.lit(0.0)), 0.0, 5.0)).drop("shift")


def blend_strata(short, long, gaps, soft=True, threshold=13, width=4.0, fallback=0.5):
    """Blend short-gap and long-gap forecasts (region_id, horizon, pred) by the region's gap."""
    j = (short.withColumnRenamed("pred", "_s").join(long.withColumnRenamed("pred", "_l"), [KEY, "horizon"], "full")
         .join(gaps, KEY, "left"))
    gap = F.coalesce("gap_weeks", F.lit(float(threshold)))
    if soft:
        w = F.least(F.greatest((gap - threshold) / width, F.lit(0.0)), F.lit(1.0))
        both = clip((1 - w) * F.col("_s") + w * F.col("_l"), 0.0, 5.0)
    else:
        both = F.when(F.col("gap_weeks") < threshold, F.col("_s")).otherwise(F.col("_l"))
    return j.select(KEY, "horizon", F.coalesce(both, "_s", "_l", F.lit(fallback)).alias("pred"))
