"""Baselines, errors and reports on long prediction tables.

Tables have the columns region_id, week_idx, horizon, pred, truth and often member.
"""
from pyspark.sql import functions as F

from panelcast.config import HORIZONS, KEY, WEEK, WEEK_CHUNK
from panelcast.functions import ranks
from panelcast.functions.chunks import chunked, frame, owned
from panelcast.functions.scalars import clip, corr
from panelcast.operators.cleaning import attach


def error():
    return F.abs(F.col("pred") - F.col("truth"))


def baseline_predictions(kind, train, rows):
    """Column `pred` of a simple forecast: zero, persistence or region_mean."""
    if kind == "zero":
        return rows.withColumn("pred", F.lit(0.0))
    if kind == "persistence":
        return rows.withColumn("pred", F.col("score").cast("double"))
    if kind == "region_mean":
        means = train.groupBy(KEY).agg(F.avg("score").alias("_m"))
        overall = train.agg(F.avg("score")).scalar()
        return rows.join(means, KEY, "left").withColumn("pred", F.coalesce("_m", overall)).drop("_m")
    raise ValueError(f"unknown baseline {kind!r}")


def long_targets(anchors):
    """Anchors with target_w1..5 to one row per known target."""
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"target_w{h}").cast("double").alias("y")) for h in HORIZONS])
    keep = [c for c in anchors.columns if not c.startswith("target_w")]
    out = anchors.select(*keep, F.explode(pairs).alias("p")).filter("p.y IS NOT NULL")
    return out.select(*keep, F.col("p.h").alias("horizon"), F.col("p.y").alias("truth"))


def _by_horizon(value, condition=None):
    return [F.avg(F.when(F.col("horizon") == h, value)).alias(f"mae_w{h}") for h in HORIZONS]


def _mean_of_horizons(prefix="mae_w"):
    """Unweighted mean of the horizons that have rows."""
    cols = [F.col(f"{prefix}{h}") for h in HORIZONS]
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0))), n)


def macro_mae(preds, by=()):
    """Error per horizon and their unweighted mean; rows without truth do not count."""
    out = preds.groupBy(*by).agg(*_by_horizon(error()))
    return out.withColumn("macro_mae", _mean_of_horizons())


def full_metrics(preds, by):
    """MAE, RMSE, R2, bias, 95th percentile of the error, MASE and MAE per true score.

    The naive error behind MASE is the mean absolute change of the truth from one week to
    the next within a region.
    """
    p = preds.withColumns({"pred": clip(F.col("pred"), 0.0, 5.0), "truth": clip(F.col("truth"), 0.0, 5.0)})
    p = p.withColumn("abs_error", error())
    previous = frame([*by, KEY], WEEK)
    p = owned(chunked(p, WEEK, WEEK_CHUNK, before=1).withColumn(
        "_step", F.abs(F.col("truth") - F.lag("truth", 1).over(previous))))
    main = p.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.pow(F.col("pred") - F.col("truth"), 2))).alias("rmse"),
        F.try_divide(F.sum(F.pow(F.col("pred") - F.col("truth"), 2)), F.var_pop("truth") * F.count("truth")).alias("_u"),
        F.avg(F.col("pred") - F.col("truth")).alias("bias"), F.avg("_step").alias("_naive"),
        *[F.avg(F.when(F.col("truth") == s, F.col("abs_error"))).alias(f"mae_score{s}") for s in range(6)])
    p95 = ranks.spread(ranks.exact_quantiles(p, ["abs_error"], [0.95], by=by),
                       {"p95_abs_error": ("abs_error", 0)}, by=by)
    out = main.join(p95, list(by)).withColumns({
        "r2": 1 - F.col("_u"), "mase": F.col("mae") / F.greatest(F.coalesce("_naive", F.lit(1.0)), F.lit(1e-6))})
    return out.drop("_u", "_naive")


def region_errors(preds, by=()):
    """Per region count, error and means, worst first."""
    p = preds.withColumns({"pred": clip(F.col("pred"), 0.0, 5.0), "truth": clip(F.col("truth"), 0.0, 5.0)})
    return p.groupBy(*by, KEY).agg(
        F.count("*").alias("n"), F.avg(error()).alias("mae"), F.avg("truth").alias("mean_true"),
        F.avg("pred").alias("mean_pred")).orderBy(F.desc("mae"))


def cluster_errors(preds, clusters, by=()):
    """Per cluster rows, regions and errors; regions without cluster are -1."""
    joined = preds.join(clusters.select(KEY, "region_cluster_id"), KEY, "left")
    joined = joined.withColumn("cluster_id", F.coalesce("region_cluster_id", F.lit(-1)))
    per_region = joined.groupBy(*by, "cluster_id", KEY).agg(
        F.count_if(F.col("horizon") == 1).alias("_rows"),
        *[F.sum(F.when(F.col("horizon") == h, error())).alias(f"_e{h}") for h in HORIZONS],
        *[F.count(F.when(F.col("horizon") == h, error())).alias(f"_n{h}") for h in HORIZONS])
    out = per_region.groupBy(*by, "cluster_id").agg(
        F.sum("_rows").alias("n_rows"), F.count("*").alias("n_regions"),
        *[(F.sum(f"_e{h}") / F.sum(f"_n{h}")).alias(f"mae_w{h}") for h in HORIZONS])
    return out.withColumn("macro_mae", _mean_of_horizons()).orderBy(F.desc("macro_mae"))


def cluster_average(report, preds, by=()):
    """Mean over known clusters of their macro error, else the overall macro error."""
    known = report.filter("cluster_id >= 0").groupBy(*by).agg(F.avg("macro_mae").alias("_c"))
    overall = macro_mae(preds, by)
    joined = overall.join(known, list(by), "left") if by else attach(overall, known, "_k").withColumn("_c", F.col("_k._c"))
    return joined.select(*by, F.coalesce("_c", "macro_mae").alias("cluster_mae"), "macro_mae")


BUCKETS = {"0": (-0.5, 0.5), "12": (0.5, 2.5), "345": (2.5, 5.5)}


def bias_report(preds, by=()):
    """Errors, biases per horizon and severity, and the shares of low predictions and truths."""
    p = preds.filter(F.col("truth").isNotNull()).withColumn("pred", clip(F.col("pred"), 0.0, 5.0))
    signed = F.col("pred") - F.col("truth")
    y = F.col("truth")
    out = p.groupBy(*by).agg(
        *_by_horizon(error()),
        *[F.avg(F.when(F.col("horizon") == h, signed)).alias(f"bias_w{h}") for h in HORIZONS],
        F.avg("pred").alias("pred_mean"), F.avg("truth").alias("true_mean"), F.avg(signed).alias("mean_bias"),
        *[F.avg(F.when((y >= lo) & (y < hi), error())).alias(f"mae_bucket_{n}") for n, (lo, hi) in BUCKETS.items()],
        F.avg((F.col("pred") <= 0.5).cast("double")).alias("frac_pred_low"),
        F.avg((y <= 0.5).cast("double")).alias("frac_true_zero"), F.count("*").alias("n"))
    return out.withColumn("macro_mae", _mean_of_horizons())


def fold_summary(folds, value="mae", by=()):
    return folds.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), (F.stddev_pop(value) / F.avg(value)).alias("cv_stability"))


def horizon_drops(report, tolerance=0.05):
    """Flag horizons whose error is lower than the previous one by more than the tolerance."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"mae_w{h}").alias("mae"),
                               (F.col(f"mae_w{h - 1}") if h > 1 else F.lit(None).cast("double")).alias("previous"))
                      for h in HORIZONS])
    keep = [c for c in report.columns if not c.startswith("mae_w") and c != "macro_mae"]
    out = report.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")
    return out.withColumn("drops", F.coalesce(F.col("previous") > F.col("mae") + tolerance, F.lit(False)))


def describe(wide, cols):
    """count, mean, std, min, quartiles and max per column, one row each."""
    aggs = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = wide.agg(*[fn(c).cast("double").alias(f"{c}__{n}") for c in cols for n, fn in aggs.items()])
    rows = one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), *[F.col(f"{c}__{n}").alias(n) for n in aggs]) for c in cols])).alias("r")).select("r.*")
    q = ranks.exact_quantiles(wide, cols, [0.25, 0.5, 0.75])
    quart = q.groupBy(F.col("channel").alias("column_name")).agg(
        *[F.max(F.when(F.col("q") == i, F.col("value"))).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])
    return rows.join(quart, "column_name")


def prediction_profile(preds, by=()):
    """Level, first and last week, decay, low and severe shares and median of predictions."""
    h = F.col("horizon")
    main = preds.groupBy(*by).agg(
        F.avg("pred").alias("mean"), F.avg(F.when(h == 1, F.col("pred"))).alias("week1"),
        F.avg(F.when(h == 5, F.col("pred"))).alias("week5"), F.avg((F.col("pred") < 0.5).cast("double")).alias("frac_low"),
        (100 * F.avg((F.col("pred") >= 3).cast("double"))).alias("pct_severe"))
    median = ranks.spread(ranks.exact_quantiles(preds, ["pred"], [0.5], by=by), {"median": ("pred", 0)}, by=by)
    joined = main.join(median, list(by)) if by else attach(main, median, "_m").withColumn("median", F.col("_m.median"))
    return joined.withColumn("decay", F.col("week1") - F.col("week5"))


def compare_predictions(a, b, keys=(KEY, WEEK, "horizon")):
    """Largest and mean absolute difference and correlation of two prediction tables."""
    j = a.select(*keys, F.col("pred").alias("x")).join(b.select(*keys, F.col("pred").alias("y")), list(keys))
    diff = F.abs(F.col("x") - F.col("y"))
    return j.agg(F.count("*").alias("n"), F.max(diff).alias("max_abs"), F.avg(diff).alias("mean_abs"),
                 corr("x", "y").alias("corr"))
