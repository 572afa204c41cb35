"""Train/validation splits, folds, samples and column choices.

One chosen row per region is taken with max_by/min_by over an ordering struct, which
aggregates partially before the shuffle; random choices are hashes of the row key, so a
recomputed partition chooses the same rows.
"""
from pyspark.sql import functions as F

from panelcast.config import DAYS_PER_WEEK, HORIZONS, KEY, WEEK
from panelcast.functions.calendar import circular_distance, region_number
from panelcast.functions.chunks import with_position, with_running_sum
from panelcast.operators.cleaning import attach

TARGETS = [f"target_w{h}" for h in HORIZONS]
SLACK_WEEKS, PURGE_WEEKS, BANDWIDTH_MONTHS = 6, 13, 2


def flag_val(df, condition):
    return df.withColumn("part", F.when(condition, "val").otherwise("train"))


def fixed_split(df, weeks, n_val):
    """The last n_val anchors that still have five later weeks are validation."""
    return flag_val(df, F.col(WEEK) > weeks - 6 - n_val)


def with_woy_distance(df, meta, woy="woy", test_woy="test_woy", period=52):
    joined = df.join(meta.select(KEY, test_woy), KEY, "left")
    return joined.withColumn("woy_dist", circular_distance(F.col(woy), F.col(test_woy), period))


def calendar_split(df, meta, slack=SLACK_WEEKS, last_year_only=True):
    """Weeks near the region's test week, in the region's last 52 weeks, are validation."""
    out = with_woy_distance(df, meta)
    near = F.col("woy_dist") <= slack
    if last_year_only:
        out = out.join(df.groupBy(KEY).agg(F.max(WEEK).alias("_max")), KEY)
        near = near & (F.col(WEEK) > F.col("_max") - 52)
    return flag_val(out, F.coalesce(near, F.lit(False))).drop("_max")


def closest_row(df):
    """Per region the row nearest to the test week, the latest of equal ones."""
    best = F.min_by(F.struct(*[c for c in df.columns if c != KEY]), F.struct("woy_dist", -F.col(WEEK)))
    return df.groupBy(KEY).agg(best.alias("r")).select(KEY, "r.*")


def walk_forward(df, boundaries, horizon=5):
    """Rows labelled per boundary: train up to it, validation in the next `horizon` weeks."""
    folds = F.transform(F.lit(boundaries), lambda b: F.struct(
        b.alias("boundary"), F.when(F.col(WEEK) <= b, "train")
        .when(F.col(WEEK) <= b + horizon, "val").alias("part")))
    out = df.withColumn("_f", F.explode(F.filter(folds, lambda x: x["part"].isNotNull())))
    return out.select(*df.columns, "_f.boundary", "_f.part")


def purged_folds(df, n_splits, gap_days, time="ord", tie=("horizon",), chunk=4096):
    """Walk-forward folds over equal blocks of rows in time order, with a purge gap.

    Fold f validates on block f and trains on rows at least `gap_days` before the block's
    first day. Block borders come from the histogram of days; only rows on a day that a
    border cuts are ranked among each other (by region number and `tie`).
    """
    days = df.groupBy(time).agg(F.count("*").alias("_n"))
    days = with_running_sum(days, time, "_n", "_before", chunk)
    size = df.agg(F.floor(F.count("*") / n_splits).alias("block")).scalar()
    days = days.withColumn("_block", size)
    cuts = F.filter(F.sequence(F.lit(1), F.lit(n_splits - 1)), lambda f: (
        f * F.col("_block") >= F.col("_before")) & (f * F.col("_block") < F.col("_before") + F.col("_n")))
    days = days.withColumn("_cuts", cuts)
    starts = days.select(F.explode("_cuts").alias("fold"), F.col(time).alias("start")).agg(
        F.sort_array(F.collect_list(F.struct("fold", "start"))).alias("starts"))
    rows = df.join(days, time)
    cut_days = rows.filter(F.size("_cuts") > 0).withColumn("_tie", region_number(F.col(KEY)))
    order = "_order"
    cut_days = cut_days.withColumnRenamed("_before", "_day_before")
    ranked = with_position(cut_days.withColumn(order, F.struct("_tie", F.col(KEY).alias("_key"), *tie)), [time], order, "_rank",
                           chunk_expr=F.coalesce(F.floor(F.col("_tie") / 65536), F.lit(-1))).drop("_tie", order).withColumnRenamed("_day_before", "_before")
    whole = rows.filter(F.size("_cuts") == 0).withColumn("_rank", F.lit(0).cast("bigint"))
    placed = whole.unionByName(ranked).withColumn(
        "_at", F.least(F.lit(n_splits - 1), F.floor((F.col("_before") + F.col("_rank")) / F.col("_block"))))
    first = df.agg(F.min(time)).scalar()
    placed = attach(placed, starts, "_s").withColumn("_first", first)
    folds = F.transform(F.col("_s.starts"), lambda s: F.struct(
        s["fold"].alias("fold"),
        F.when(s["start"] - gap_days < F.col("_first"), F.lit(None))
        .when(F.col("_at") == s["fold"], "val")
        .when(F.col(time) <= s["start"] - gap_days, "train").alias("part")))
    out = placed.withColumn("_f", F.explode(F.filter(folds, lambda x: x["part"].isNotNull())))
    return out.select(*df.columns, F.col("_f.fold").alias("fold"), F.col("_f.part").alias("part"))


def latest_in_season(df, meta, bandwidth=BANDWIDTH_MONTHS, by=(KEY, "horizon"), time="ord"):
    """Per region and horizon the newest row within `bandwidth` months of the test month."""
    joined = df.join(meta.select(KEY, "test_month"), KEY).withColumn(
        "month_dist", circular_distance(F.col("month"), F.col("test_month"), 12))
    near = joined.filter(F.col("month_dist") <= bandwidth)
    row = F.max_by(F.struct(*[c for c in near.columns if c not in by]), time)
    return near.groupBy(*by).agg(row.alias("r")).select(*by, "r.*")


def season_validation(val, meta, by, bandwidth=BANDWIDTH_MONTHS, minimum=20):
    """In-season validation rows of every fold that has enough of them, else all its rows."""
    joined = val.join(meta.select(KEY, "test_month"), KEY, "left")
    near = F.coalesce(circular_distance(F.col("month"), F.col("test_month"), 12) <= bandwidth, F.lit(True))
    joined = joined.withColumn("_near", near)
    enough = joined.groupBy(*by).agg((F.count_if("_near") >= minimum).alias("_enough"))
    return joined.join(enough, list(by)).filter(F.col("_near") | ~F.col("_enough")).drop("_near", "_enough", "test_month")


def _hold_out(df, preference, purge_weeks):
    """Flag each region's preferred row as val, rows near it as purged, the rest as train."""
    chosen = df.groupBy(KEY).agg(F.max_by("ord", preference).alias("_val_ord"))
    out = df.join(chosen, KEY)
    gap = F.abs(F.col("ord") - F.col("_val_ord"))
    return out.withColumn("part", F.when(gap == 0, "val").when(gap < purge_weeks * DAYS_PER_WEEK, "purged")
                          .otherwise("train")).drop("_val_ord")


def hot_holdout(anchors, test_weeks, selection="precip_deficit", slack=SLACK_WEEKS, purge_weeks=PURGE_WEEKS,
                temp="tmp_max_mean", offset=4.0):
    """Hold out each region's driest in-season week, or the one best matching the test heat.

    In-season weeks come first; among equals the earliest week wins.
    """
    meta = test_weeks.select(KEY, F.col("woy1").alias("test_woy1"), F.col(temp).alias("_test_temp"))
    df = with_woy_distance(anchors, meta, "woy1", "test_woy1", 53)
    if selection == "precip_deficit":
        means = anchors.groupBy(KEY).agg(F.avg("prec_sum").alias("_mean"))
        df = df.join(means, KEY).withColumn("_score", F.col("_mean") - F.col("prec_sum")).drop("_mean")
    elif selection == "temp_match":
        df = df.join(meta.select(KEY, "_test_temp"), KEY).withColumn(
            "_score", -F.abs(F.col(temp) - (F.col("_test_temp") + offset))).drop("_test_temp")
    else:
        raise ValueError(f"unknown selection {selection!r}")
    preference = F.struct(F.col("woy_dist") <= slack, F.col("_score"), -F.col("ord"))
    return _hold_out(df, preference, purge_weeks).drop("_score")


def season_holdout(anchors, test_weeks, slack=SLACK_WEEKS, purge_weeks=PURGE_WEEKS):
    """Hold out each region's newest in-season week, else its first week."""
    meta = test_weeks.select(KEY, F.col("woy1").alias("test_woy1"))
    df = with_woy_distance(anchors, meta, "woy1", "test_woy1", 53)
    near = F.col("woy_dist") <= slack
    return _hold_out(df, F.struct(near, F.when(near, F.col("ord")).otherwise(-F.col("ord"))), purge_weeks)


def hashed_share(keys, seed, buckets=1000):
    """Uniform number 0 .. buckets-1 that depends only on the row key; any engine with MD5 draws the same."""
    return F.conv(F.substring(_digest(keys, seed), 1, 12), 16, 10).cast("bigint") % buckets


def _digest(keys, seed):
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hashed_rank(keys, seed):
    """Order of rows that depends only on their key."""
    return F.substring(_digest(keys, seed), 1, 16)


def random_split(df, keys, val_share=0.1, seed=42):
    return flag_val(df, hashed_share(keys, seed) < val_share * 1000)


def by_stratum(df, strata):
    """Region stratum of every row; an unknown region counts as long."""
    return df.join(strata, KEY, "left").withColumn("stratum", F.coalesce("stratum", F.lit("long")))


def season_and_tail(df, slack=SLACK_WEEKS, share=0.2, seed=42):
    """All in-season rows and a hashed share of the others."""
    return df.filter((F.col("woy_dist") <= slack) | (hashed_share([KEY, WEEK], seed) < share * 1000))


def recent_biased(scored, k=200, minimum=10, recent=0.4, seed=42, chunk=1024):
    """At most k scored days per region, drawn from the newest 40 % first."""
    sizes = scored.groupBy(KEY).agg(F.count("*").alias("_n"))
    ranked = with_position(scored, KEY, "day_idx", "_pos", chunk).join(sizes, KEY).filter(F.col("_n") >= minimum)
    old = (F.col("_pos") < F.floor(F.col("_n") * (1 - recent))).cast("int")
    from pyspark.sql import Window
    w = Window.partitionBy(KEY).orderBy("_old", "_hash")
    marked = ranked.withColumns({"_old": old, "_hash": hashed_rank([KEY, "day_idx"], seed)})
    return marked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_old", "_hash", "_r", "_n", "_pos")


def first_rows(df, order, k):
    """The first k rows of each region by `order`; the limit applies before the shuffle too."""
    from pyspark.sql import Window
    w = Window.partitionBy(KEY).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def capped_regions(df, k=250, seed=42):
    return first_rows(df, [hashed_rank([KEY, WEEK], seed)], k)


def newest_scored(daily, k=40, first=7):
    """The newest k scored days per region, then only those at position `first` or later."""
    return first_rows(daily.filter(F.col("score").isNotNull()), [F.desc("day_idx")], k).filter(F.col("day_idx") >= first)


def thin_quiet(anchors, keep=0.5, seed=42):
    """Keep a hashed share of the anchors whose five targets are all zero."""
    quiet = sum((F.col(t) for t in TARGETS[1:]), F.col(TARGETS[0])) == 0
    return anchors.filter(~quiet | (hashed_share([KEY, WEEK], seed) < keep * 1000))


def region_overlap(train, test):
    """Number of regions in both parts and in only one of them."""
    flags = train.select(KEY, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select(KEY, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(KEY).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return flags.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"),
                     F.count_if(F.col("b") == 0).alias("n_only_train"), F.count_if(F.col("a") == 0).alias("n_only_test"))


def allowed_columns(columns, allowed, carve_out="_p95_"):
    """Columns in the allowlist, plus every newer column carrying the carve-out mark."""
    allowed = set(allowed)
    return [c for c in columns if c in allowed or carve_out in c]


def lean_columns(columns):
    """Columns without the features that carry a shift of the region's level."""
    return [c for c in columns if "_ranom" not in c and not c.startswith(("prec_deficit", "heat_dd", "aridity"))]


def lag0_weather_columns(columns):
    other = ("anom_", "region_", "cluster_", "score_lag", "month_", "doy_", "int_", "slope")
    return [c for c in columns if c.endswith("_lag0") and not c.startswith(other)]


STRESS_WEIGHTS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0]
# The two published errors the holdout is compared with.
ZERO_TARGET, MEAN_TARGET = 1.2088, 0.9364


def calibrate_selection(anchors, test_weeks, slack=SLACK_WEEKS):
    """Error of the zero and region-mean forecasts on eight candidate holdouts.

    Every candidate is one max_by in the same aggregation per region.
    """
    meta = test_weeks.select(KEY, F.col("woy1").alias("test_woy1"))
    df = with_woy_distance(anchors, meta, "woy1", "test_woy1", 53)
    fit = anchors.groupBy(KEY).agg(
        F.avg("prec_sum").alias("_pm"), F.stddev_samp("prec_sum").alias("_ps"), F.avg("tmp_max_mean").alias("_tm"),
        F.stddev_samp("tmp_max_mean").alias("_ts"), F.avg("score").alias("region_mean"))
    def unit(s):
        return F.when(F.col(s) == 0, 1.0).otherwise(F.col(s))
    df = df.join(fit, KEY).withColumns({"z_def": (F.col("_pm") - F.col("prec_sum")) / unit("_ps"),
                                        "z_tmax": (F.col("tmp_max_mean") - F.col("_tm")) / unit("_ts")})
    scores = {"precip_deficit": F.col("z_def"),
              **{f"drought_stress_w{w}": F.col("z_def") + w * F.col("z_tmax") for w in STRESS_WEIGHTS},
              "temp_only": F.col("z_tmax")}
    row = F.struct("region_mean", *TARGETS)
    picks = df.groupBy(KEY).agg(*[
        F.max_by(row, F.struct(F.col("woy_dist") <= slack, F.when(F.col("woy_dist") <= slack, s), -F.col("ord"))).alias(n)
        for n, s in scores.items()])
    long = picks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"`{n}`").alias("v"))
                                            for n in scores])).alias("p"))
    per = long.groupBy(F.col("p.strategy").alias("strategy")).agg(
        F.count("*").alias("n"),
        *[F.avg(F.abs(F.col(f"p.v.{t}"))).alias(f"_z_{t}") for t in TARGETS],
        *[F.avg(F.abs(F.col("p.v.region_mean") - F.col(f"p.v.{t}"))).alias(f"_m_{t}") for t in TARGETS])
    zero = sum((F.col(f"_z_{t}") for t in TARGETS[1:]), F.col("_z_target_w1")) / 5
    mean = sum((F.col(f"_m_{t}") for t in TARGETS[1:]), F.col("_m_target_w1")) / 5
    out = per.select("strategy", "n", zero.alias("zero_mae"), mean.alias("mean_mae")).withColumns({
        "mean_beats_zero": F.col("mean_mae") < F.col("zero_mae"),
        "dist": F.sqrt(F.pow(F.col("zero_mae") - ZERO_TARGET, 2) + F.pow(F.col("mean_mae") - MEAN_TARGET, 2))})
    best = out.agg(F.min(F.when(F.col("mean_beats_zero"), F.col("dist")))).scalar()
    return out.withColumn("best", F.coalesce(F.col("mean_beats_zero") & (F.col("dist") == best), F.lit(False)))
