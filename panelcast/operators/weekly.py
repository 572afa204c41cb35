"""Daily rows to weekly rows."""
from pyspark.sql import Window, functions as F

from panelcast.config import CHANNELS, DAY, DAY_CHUNK, DAYS_PER_WEEK, KEY, STATS
from panelcast.functions.blocks import top_p95_sql
from panelcast.functions.chunks import CHUNK, OWN, chunked, frame, with_position

META = ["month", "doy", "doy366", "woy", "woy1", "ord"]
DRY_DAY_MM = 1.0


STAT_SQL = {
    "mean": "avg({c})", "std": "stddev_pop({c})", "min": "min({c})", "max": "max({c})",
    "sum": "coalesce(sum({c}), 0D)",
    # at most seven values, so the 95th percentile lies between the two largest
    "p95": top_p95_sql("count({c})", "sort_array(collect_list({c}), false)"),
}


def _stats(channels, stats, strict=False):
    out = []
    for c in channels:
        for s in stats:
            value = STAT_SQL[s].format(c=c)
            if strict:
                value = f"CASE WHEN count({c}) = {DAYS_PER_WEEK} THEN {value} END"
            out.append(F.expr(f"{value} AS {c}_{s}"))
    return out


def _meta(daily):
    return [c for c in META if c in daily.columns]


def weekly_at_anchors(daily, channels=CHANNELS, stats=STATS, strict=False):
    """One row per scored day with statistics of its trailing seven rows.

    Nulls are skipped; early anchors use the rows that exist. With `strict` an anchor needs
    seven rows and a channel with a null among them gives null. `week_idx` counts the scored
    days of the region from 0. Every daily row is sent to the anchors that cover it, then
    aggregated; the aggregation reuses the partitioning of the frame.
    """
    cut = chunked(daily, DAY, DAY_CHUNK, before=DAYS_PER_WEEK - 1)
    anchor = F.when(F.col(OWN) & F.col("score").isNotNull(), F.col(DAY))
    ahead = frame(KEY, DAY).rowsBetween(0, DAYS_PER_WEEK - 1)
    sent = cut.withColumn("_all", F.collect_list(anchor).over(ahead)).withColumn("_to", F.explode("_all"))
    out = sent.groupBy(KEY, CHUNK, F.col("_to").alias(DAY)).agg(
        F.count("*").alias("_rows"), *_stats(channels, stats, strict),
        *[F.expr(f"max(CASE WHEN {DAY} = _to THEN {c} END) AS {c}") for c in [*_meta(daily), "score"]])
    if strict:
        out = out.filter(F.col("_rows") == DAYS_PER_WEEK)
    return with_position(out.drop(CHUNK, "_rows"), KEY, DAY, "week_idx", DAY_CHUNK)


def weekly_blocks(daily, channels=CHANNELS, stats=STATS, keep=(), strict=False):
    """Fixed seven-row blocks from the start; an incomplete last block is dropped."""
    week = F.floor(F.col(DAY) / DAYS_PER_WEEK)
    out = daily.groupBy(KEY, week.alias("week_idx")).agg(
        F.count("*").alias("_rows"), *_stats(channels, stats, strict),
        *[F.expr(f"max_by({c}, {DAY}) AS {c}") for c in [*_meta(daily), *keep]])
    return out.filter(F.col("_rows") == DAYS_PER_WEEK).drop("_rows")


def weekly_blocks_back(daily, channels=CHANNELS, stats=("mean", "std", "min", "max", "sum")):
    """Full seven-row blocks counted back from each region's last row, numbered upwards."""
    size = daily.groupBy(KEY).agg(F.count("*").alias("_n"), F.max(DAY).alias("_last"))
    back = F.floor((F.col("_last") - F.col(DAY)) / DAYS_PER_WEEK)
    full = F.floor(F.col("_n") / DAYS_PER_WEEK)
    placed = daily.join(size, KEY).withColumn("week_idx", full - 1 - back).filter("week_idx >= 0")
    out = placed.groupBy(KEY, "week_idx").agg(
        F.count("*").alias("_rows"), *_stats(channels, stats, True),
        *[F.max_by(c, DAY).alias(c) for c in _meta(daily)])
    return out.filter(F.col("_rows") == DAYS_PER_WEEK).drop("_rows")


def weekly_channels(daily, channels=CHANNELS):
    """Fifteen weekly channels: the means, pressure dynamics, rain extremes, heat peak.

    A null inside a week makes that channel null; days below 1 mm are counted over the
    days that have a value.
    """
    week = F.floor(F.col(DAY) / DAYS_PER_WEEK)
    inside = Window.partitionBy(KEY, "week_idx").orderBy(DAY)
    d3 = F.col("surf_pre") - F.lag("surf_pre", 3).over(inside)
    days = daily.withColumn("week_idx", week).withColumn("_d3", d3)

    def full(c, value):
        return F.when(F.count(c) == DAYS_PER_WEEK, value)
    return days.groupBy(KEY, "week_idx").agg(
        F.count("*").alias("_rows"),
        *[full(c, F.avg(c)).alias(f"{c}_mean") for c in channels],
        full("surf_pre", F.greatest(-F.min("_d3"), F.lit(0.0))).alias("surf_pre_drop"),
        full("surf_pre", F.greatest(F.max("_d3"), F.lit(0.0))).alias("surf_pre_climb"),
        full("surf_pre", F.stddev_pop("surf_pre")).alias("surf_pre_std"),
        full("prec", F.max("prec")).alias("prec_max"),
        F.count_if(F.col("prec") < DRY_DAY_MM).alias("prec_dry_count"),
        full("tmp_max", F.max("tmp_max")).alias("tmp_max_peak"),
        *[F.max_by(c, DAY).alias(c) for c in [*_meta(daily), "score"] if c in daily.columns],
    ).filter(F.col("_rows") == DAYS_PER_WEEK).drop("_rows")
