"""Historical statistics per region, week and month, and their joins onto feature rows.

Statistics are aggregated with partial sums before the shuffle and joined back by key, so
the size of a region does not matter. Percentiles of scores use `percentile`, whose state
holds at most the six score values.
"""
from pyspark.sql import functions as F

from panelcast.config import ANOMALY_CHANNELS, CHANNELS, KEY
from panelcast.functions import ranks
from panelcast.functions.calendar import forecast_month, region_number
from panelcast.functions.scalars import floor_std
from panelcast.operators.cleaning import attach

SCORE = {
    "mean": "avg(score)", "std": "stddev_samp(score)", "std0": "coalesce(stddev_samp(score), 0D)",
    "std_pop": "stddev_pop(score)", "max": "max(score)", "zero_rate": "avg(CAST(score = 0 AS DOUBLE))",
    "nonzero": "avg(CAST(score > 0 AS DOUBLE))", "severe": "avg(CAST(score >= 3 AS DOUBLE))", "n": "count(score)",
    **{f"q{p}": f"percentile(score, {p / 100})" for p in (25, 50, 75, 90)},
}


def score_stats(df, by, wanted):
    """`wanted` maps an output name to one of the score statistics."""
    scored = df.filter(F.col("score").isNotNull())
    return scored.groupBy(*by).agg(*[F.expr(f"{SCORE[s]} AS {name}") for name, s in wanted.items()])


def region_stats(weekly):
    return score_stats(weekly, [KEY], {
        "region_score_mean": "mean", "region_score_std": "std", "region_zero_rate": "zero_rate"})


def with_region_stats(df, stats):
    out = df.join(stats, KEY, "left")
    return out.withColumns({"region_score_std": F.coalesce("region_score_std", F.lit(0.0)),
                            "region_id_int": region_number(F.col(KEY))})


WOY_SCORE = {"region_woy_score_mean": "mean", "region_woy_score_std": "std0", "region_woy_score_max": "max",
             "region_woy_score_p90": "q90", "region_woy_zero_rate": "zero_rate"}


def woy_score(weekly):
    return score_stats(weekly, [KEY, "woy"], WOY_SCORE)


def fill_with_median(df, cols):
    """Null -> exact median of the column over the frame itself."""
    medians = ranks.spread(ranks.exact_quantiles(df, cols, [0.5]), {f"{c}_m": (c, 0) for c in cols})
    df = attach(df, medians, "_med")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med.{c}_m")) for c in cols}).drop("_med")


def join_woy_score(features, clim):
    return fill_with_median(features.join(clim, [KEY, "woy"], "left"), list(WOY_SCORE))


def woy_meteo(weekly, channels=ANOMALY_CHANNELS):
    return weekly.groupBy(KEY, "woy").agg(
        *[F.expr(f"avg({c}_mean) AS clim_{c}_mean") for c in channels],
        *[F.expr(f"greatest(coalesce(stddev_samp({c}_mean), 1e-3D), 1e-3D) AS clim_{c}_std") for c in channels])


def woy_anomalies(features, clim, channels=ANOMALY_CHANNELS, suffix="_mean_lag0"):
    """Current weekly mean against the history of its week; an unseen week takes the median mean."""
    joined = features.join(clim, [KEY, "woy"], "left")
    joined = fill_with_median(joined, [f"clim_{c}_mean" for c in channels])
    return joined.withColumns({
        f"anom_{c}": (F.col(f"{c}{suffix}") - F.col(f"clim_{c}_mean"))
        / F.greatest(F.coalesce(f"clim_{c}_std", F.lit(1e-3)), F.lit(1e-3)) for c in channels})


def region_meteo(daily, channels=CHANNELS):
    return daily.groupBy(KEY).agg(*[F.expr(f"avg({c}) AS {c}_mu") for c in channels],
                                  *[F.expr(f"stddev_samp({c}) AS {c}_sd") for c in channels])


def region_month_meteo(daily, channels=CHANNELS):
    return daily.groupBy(KEY, "month").agg(*[F.expr(f"avg({c}) AS {c}_mo_mean") for c in channels])


PROFILE = {"reg_mean": "mean", "reg_std": "std", "reg_q25": "q25", "reg_q75": "q75", "reg_q90": "q90",
           "reg_nonzero": "nonzero"}


def score_profile(daily):
    return score_stats(daily, [KEY], PROFILE)


def last_score(daily, order="ord"):
    row = F.max_by(F.struct("score", "gord"), order).alias("r")
    return daily.filter(F.col("score").isNotNull()).groupBy(KEY).agg(row).select(
        KEY, F.col("r.score").alias("last_score"), F.col("r.gord").alias("last_gord"))


def month_score(daily):
    return score_stats(daily, [KEY, "month"], {"mo_score": "mean"})


def with_month_scores(rows, month_table, profile, horizon="horizon"):
    """Mean score of the current month and of the forecast month, else the region mean."""
    rows = rows.withColumn("_fm", forecast_month(F.col("month"), F.col(horizon)))
    ahead = month_table.select(KEY, F.col("month").alias("_fm"), F.col("mo_score").alias("fw_score"))
    out = (rows.join(month_table, [KEY, "month"], "left").join(ahead, [KEY, "_fm"], "left")
           .join(profile.select(KEY, "reg_mean"), KEY, "left"))
    return out.withColumns({"reg_score_mo_mean": F.coalesce("mo_score", "reg_mean"),
                            "fw_score_mo_mean": F.coalesce("fw_score", "reg_mean")}).drop("_fm", "mo_score", "fw_score")


def window_anomalies(rows, base, channels, windows):
    """(window mean - region mean) / region deviation for columns `<c>_mean_<w>d`."""
    joined = rows.join(base, KEY, "left")
    return joined.withColumns({
        f"{c}_anom_{w}d": (F.col(f"{c}_mean_{w}d") - F.col(f"{c}_mu")) / floor_std(F.col(f"{c}_sd"))
        for w in windows for c in channels}).drop(*[f"{c}_{s}" for c in CHANNELS for s in ("mu", "sd")])


def month_anomalies(rows, monthly, base, channels):
    """7-day mean against the region's mean for the same month; 0 where that is unknown."""
    joined = rows.join(monthly, [KEY, "month"], "left").join(base, KEY, "left")
    return joined.withColumns({
        f"{c}_mo_anom_7d": F.coalesce((F.col(f"{c}_mean_7d") - F.col(f"{c}_mo_mean"))
                                      / floor_std(F.col(f"{c}_sd")), F.lit(0.0)) for c in channels})


SCALARS = {"region_score_mean": "mean", "region_score_std": "std0", "region_zero_rate": "zero_rate",
           "region_score_p90": "q90"}


def region_scalars(rows, pool):
    """Score statistics of the pool per region, else over the whole pool."""
    table = score_stats(pool, [KEY], SCALARS)
    overall = score_stats(pool, [], {**SCALARS, "region_score_std": "std"})
    out = attach(rows.join(table, KEY, "left"), overall, "_all")
    return out.withColumns({c: F.coalesce(c, F.col(f"_all.{c}")) for c in SCALARS}).drop("_all")


def season_scalars(rows, pool):
    """(region, month) mean and deviation, else the region's, else the pool's."""
    cell = score_stats(pool, [KEY, "month"], {"_cm": "mean", "_cs": "std0"})
    region = score_stats(pool, [KEY], {"_rm": "mean", "_rs": "std0"})
    overall = score_stats(pool, [], {"m": "mean", "s": "std"})
    out = attach(rows.join(cell, [KEY, "month"], "left").join(region, KEY, "left"), overall, "_all")
    return out.withColumns({
        "region_month_score_mean": F.coalesce("_cm", "_rm", F.col("_all.m")),
        "region_month_score_std": F.coalesce("_cs", "_rs", F.col("_all.s"))}).drop("_cm", "_cs", "_rm", "_rs", "_all")


def week_spi(weekly):
    """Weekly rain standardised within (region, week of year); a zero deviation counts as 1."""
    cell = weekly.groupBy(KEY, "woy1").agg(F.avg("prec_sum").alias("_m"), F.stddev_samp("prec_sum").alias("_s"))
    joined = weekly.join(cell, [KEY, "woy1"])
    sd = F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return joined.withColumn("spi", (F.col("prec_sum") - F.col("_m")) / sd).drop("_m", "_s")


MONTH = {"mo_mean": "mean", "mo_std": "std", "mo_q25": "q25", "mo_median": "q50", "mo_q75": "q75", "mo_q90": "q90",
         "mo_nonzero": "nonzero", "mo_severe": "severe", "mo_count": "n"}


def month_profile(daily):
    """Score statistics per (region, month), deviation of the month from the region, and the
    deviation of the month means within the region."""
    cells = score_stats(daily, [KEY, "month"], MONTH)
    region = score_stats(daily, [KEY], {"reg_mean": "mean"})
    spread = cells.groupBy(KEY).agg(F.stddev_samp("mo_mean").alias("intra_std"))
    return (cells.join(region, KEY).join(spread, KEY)
            .withColumn("mo_mean_diff", F.col("mo_mean") - F.col("reg_mean")))


def test_month_prior(daily, meta):
    """Score statistics of each region's test month, of its whole history below 3 values."""
    wanted = {"n_obs": "n", "mo_mean": "mean", "mo_std": "std_pop", "mo_q25": "q25", "mo_q50": "q50",
              "mo_q75": "q75", "mo_q90": "q90", "mo_nonzero": "nonzero", "mo_severe": "severe"}
    scored = daily.filter(F.col("score").isNotNull()).join(meta.select(KEY, "test_month"), KEY)
    in_month = "FILTER (WHERE month = test_month)"
    both = scored.groupBy(KEY, "test_month").agg(
        *[F.expr(f"{SCORE[s]} AS a_{n}") for n, s in wanted.items()],
        *[F.expr(f"{SCORE[s]} {in_month} AS m_{n}") for n, s in wanted.items()])
    few = F.col("m_n_obs") < 3
    return both.select(KEY, "test_month", *[F.when(few, F.col(f"a_{n}")).otherwise(F.col(f"m_{n}")).alias(n)
                                            for n in wanted], F.col("a_mo_mean").alias("reg_mean"))
