"""Calendar columns from date strings, with integer arithmetic only.

Years may have four or five digits and 29 February may appear in any year, so no
value here is ever cast to DATE.
"""
import math

from pyspark.sql import Column, functions as F

# Days before each month, February with 28 and with 29 days.
DAYS_BEFORE_365 = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]
DAYS_BEFORE_366 = [0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335]


def _pick(values, month):
    return F.element_at(F.expr(f"array({', '.join(str(v) for v in values)})"), month.cast("int"))


def date_parts(date):
    """(year, month, day) of `Y-MM-DD`; also `/` and `.` separators and a time suffix."""
    text = F.regexp_replace(F.trim(date), "[T ].*$", "")
    parts = F.split(F.regexp_replace(text, "[/.]", "-"), "-")
    return tuple(F.get(parts, F.lit(i)).try_cast("bigint") for i in range(3))


def doy365(month, day):
    return _pick(DAYS_BEFORE_365, month) + day


def doy366(month, day):
    return _pick(DAYS_BEFORE_366, month) + day


def woy0(doy):
    """Week bucket 0..52."""
    return F.least(F.lit(52), F.greatest(F.lit(0), F.floor((doy - 1) / 7))).cast("bigint")


def woy1(doy):
    """Week bucket 1..53."""
    return (F.floor((doy - 1) / 7) + 1).cast("bigint")


def fixed366_ordinal(year, month, day):
    """Collision-free day number on a calendar where every year has 366 days."""
    return (year - 1) * 366 + doy366(month, day)


def gregorian_ordinal(year, month, day):
    """Proleptic Gregorian day number for any year; 0 when a part is missing or invalid."""
    leap = ((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)))
    shift = F.when((month > 2) & leap, 1).otherwise(0)
    before = year - 1
    number = (before * 365 + F.floor(before / 4) - F.floor(before / 100)
              + F.floor(before / 400) + doy365(month, day) + shift)
    valid = month.between(1, 12) & day.isNotNull() & year.isNotNull()
    return F.coalesce(F.when(valid, number), F.lit(0)).cast("bigint")


def month_from_doy(doy):
    """Month whose 365-day offsets contain the day of year, kept within 1..12."""
    offsets = F.expr(f"array({', '.join(str(v) for v in DAYS_BEFORE_365)})")
    passed = F.size(F.filter(offsets, lambda v: v < doy))
    return F.least(F.lit(12), F.greatest(F.lit(1), passed)).cast("bigint")


def circular_distance(a, b, period):
    gap = F.abs(a - b)
    return F.least(gap, F.lit(period) - gap)


def cyclic(value, period):
    angle = 2 * math.pi * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def season(month):
    return (F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM")
            .when(month.isin(6, 7, 8), "JJA").otherwise("SON"))


def quarter(month):
    return F.floor((month - 1) / 3) + 1


def forecast_month(month, horizon):
    """Month reached by a weekly horizon, four weeks counted as one month."""
    return (month - 1 + F.floor((horizon - 1) / 4)) % 12 + 1


def with_calendar(df, date="date"):
    """Add year, month, day, both days of year, both week buckets and both day numbers."""
    year, month, day = date_parts(F.col(date))
    df = df.withColumns({"year": year, "month": month, "day": day})
    y, m, d = F.col("year"), F.col("month"), F.col("day")
    df = df.withColumns({
        "doy": doy365(m, d).cast("bigint"), "doy366": doy366(m, d).cast("bigint"),
        "ord": fixed366_ordinal(y, m, d).cast("bigint"), "gord": gregorian_ordinal(y, m, d)})
    return df.withColumns({"woy": woy0(F.col("doy")), "woy1": woy1(F.col("doy366"))})


def region_number(region_id) -> Column:
    """'R123' -> 123; null where the rest of the id isn't a number that fits."""
    return F.substring(region_id, F.lit(2), F.length(region_id)).try_cast("bigint")


def dense_index(df, key="region_id", out="region_index"):
    """Distinct keys numbered 0.. in key order.

    Keys are range-partitioned and numbered within their range; only the table of ranges, one row
    each, is summed by one task. The ranges are stored, so both passes see the same ones.
    """
    from pyspark.sql import Window

    from panelcast.sources.files import store
    place = F.monotonically_increasing_id()
    ids = df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).select(
        key, F.shiftright(place, 33).alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_place"))
    ids = store(ids, "ids")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ids.join(sizes.drop("_n"), "_range").select(key, (F.col("_before") + F.col("_place")).alias(out))
