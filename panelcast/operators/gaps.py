"""Weeks between the end of a region's history and its forecast window, and what follows."""
from pyspark.sql import functions as F

GAP_SHORT_WEEKS = 13
DEFAULT_GAP_WEEKS = 52.0


def test_meta(test, day="day_idx"):
    """Per region: week and month of the last test day, month of the first one."""
    def last(c):
        return F.max_by(c, day)
    return test.groupBy("region_id").agg(
        last("woy").alias("test_woy"), last("woy1").alias("test_woy1"),
        F.min_by("month", day).alias("test_month"), last("month").alias("end_month"),
        last("doy366").alias("test_doy"), last("ord").alias("test_ord"))


def test_meta_struct(test, day="day_idx"):
    """Anchor row of each region's test part, taken as one struct."""
    row = F.max_by(F.struct("ord", "woy1", "month", "doy366"), day).alias("a")
    return test.groupBy("region_id").agg(row).select(
        "region_id", F.col("a.ord").alias("test_anchor_ord"), F.col("a.woy1").alias("test_anchor_woy"),
        F.col("a.month").alias("test_anchor_month"), F.col("a.doy366").alias("test_anchor_doy"))


def gap_weeks(train, test, method="gregorian", day="day_idx"):
    """(region_id, gap_weeks) for every test region.

    `approx`: 365-day years and 30-day months, only regions seen in both parts;
    `gregorian`: exact days, never negative, 52 for a region without history;
    `fixed366`: train end to the last test day on the 366-day calendar.
    """
    at_end = F.max_by(F.struct("year", "month", "day", "gord", "ord"), day)
    ends = train.groupBy("region_id").agg(at_end.alias("e"))
    first = F.min_by(F.struct("year", "month", "day", "gord", "ord"), day)
    last = F.max_by(F.struct("year", "month", "day", "gord", "ord"), day)
    starts = test.groupBy("region_id").agg(first.alias("s"), last.alias("l"))
    both = starts.join(ends, "region_id", "inner" if method == "approx" else "left")
    if method == "approx":
        gap = ((F.col("s.year") - F.col("e.year")) * 365 + (F.col("s.month") - F.col("e.month")) * 30
               + (F.col("s.day") - F.col("e.day"))) / 7
    elif method == "gregorian":
        gap = F.coalesce(F.greatest(F.col("s.gord") - F.col("e.gord"), F.when(F.col("e").isNotNull(), 0)) / 7,
                         F.lit(DEFAULT_GAP_WEEKS))
        gap = F.when(F.col("e").isNull(), DEFAULT_GAP_WEEKS).otherwise(gap)
    elif method == "fixed366":
        gap = (F.col("l.ord") - F.col("e.ord")) / 7
    else:
        raise ValueError(f"unknown method {method!r}")
    return both.select("region_id", gap.alias("gap_weeks"))


def stratum(gap, threshold=GAP_SHORT_WEEKS):
    return F.when(gap < threshold, "short").otherwise("long")


def gap_bucket(gap):
    """20-week buckets; everything outside 0..80 falls in the last one."""
    return (F.when((gap >= 0) & (gap < 20), "0-20w").when((gap >= 20) & (gap < 40), "20-40w")
            .when((gap >= 40) & (gap < 60), "40-60w").when((gap >= 60) & (gap < 80), "60-80w")
            .otherwise("80w+"))
