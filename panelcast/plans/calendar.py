"""Calendar and key scalars."""
from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.operators import gaps
from panelcast.plans.base import query
from panelcast.plans.inputs import gapped_train, test, train
from panelcast.sources.panel import calendar_panel, panel

KEYS = "region_id:s day_idx:i"


@query("cal_parts", KEYS + " year:i month:i day:i",
       "SELECT region_id, day_idx, year + 8000 AS year, month, day FROM panel")
def cal_parts(spark, d):
    """Years moved across the 4-to-5-digit border, three notations of the same date."""
    p = calendar_panel(spark, d)
    y = (F.col("year") + 8000).cast("string")
    rest = F.substring("date", 5, 6)
    text = (F.when(F.col("day_idx") % 3 == 0, F.concat(y, F.translate(rest, "-", "/"), F.lit("T00:00:00")))
            .when(F.col("day_idx") % 3 == 1, F.concat(y, F.translate(rest, "-", "."), F.lit(" 00:00")))
            .otherwise(F.concat(y, rest)))
    year, month, day = cal.date_parts(text)
    return p.select("region_id", "day_idx", year.alias("year"), month.alias("month"), day.alias("day"))


@query("cal_doy365", KEYS + " doy:i", "SELECT region_id, day_idx, doy FROM panel")
def cal_doy365(spark, d):
    return calendar_panel(spark, d)


@query("cal_woy0", KEYS + " woy:i", "SELECT region_id, day_idx, woy FROM panel")
def cal_woy0(spark, d):
    return calendar_panel(spark, d)


@query("cal_woy1", KEYS + " woy1:i", "SELECT region_id, day_idx, woy1 FROM panel")
def cal_woy1(spark, d):
    return calendar_panel(spark, d)


@query("cal_fixed366", KEYS + " ord:i doy366:i woy1:i", "SELECT region_id, day_idx, ord, doy366, woy1 FROM panel")
def cal_fixed366(spark, d):
    return calendar_panel(spark, d)


@query("cal_gregord", KEYS + " gord:i far:i bad:i",
       "SELECT region_id, day_idx, gord, gord + 20*146097 AS far, 0 AS bad FROM panel")
def cal_gregord(spark, d):
    """Also 8000 years later (20 full 400-year cycles) and for an unreadable date."""
    p = calendar_panel(spark, d)
    far = cal.gregorian_ordinal(F.col("year") + 8000, F.col("month"), F.col("day"))
    bad = cal.gregorian_ordinal(*cal.date_parts(F.concat(F.lit("x"), F.col("date"))))
    return p.select("region_id", "day_idx", "gord", far.alias("far"), bad.alias("bad"))


@query("cal_month_from_doy", KEYS + " m:i", "SELECT region_id, day_idx, CASE WHEN doy = 60 THEN 3 ELSE month END AS m FROM panel")
def cal_month_from_doy(spark, d):
    """29 February and 1 March share a day of year, which belongs to March."""
    return calendar_panel(spark, d).withColumn("m", cal.month_from_doy(F.col("doy")))


@query("cal_circdist", KEYS + " woy52:i woy53:i mon12:i", """
SELECT region_id, day_idx, least(abs(woy-test_woy), 52-abs(woy-test_woy)) woy52,
  least(abs(woy1-test_woy1), 53-abs(woy1-test_woy1)) woy53,
  least(abs(month-test_month), 12-abs(month-test_month)) mon12
FROM train JOIN tmeta USING (region_id)""")
def cal_circdist(spark, d):
    j = train(spark, d).join(gaps.test_meta(test(spark, d)), "region_id")
    return j.select("region_id", "day_idx",
                    cal.circular_distance(F.col("woy"), F.col("test_woy"), 52).alias("woy52"),
                    cal.circular_distance(F.col("woy1"), F.col("test_woy1"), 53).alias("woy53"),
                    cal.circular_distance(F.col("month"), F.col("test_month"), 12).alias("mon12"))


CYCLES = [("month", "month", 12), ("doy", "doy", 365), ("doy366", "doy366", 366), ("woy", "woy1", 52)]


@query("cal_cyclic", KEYS + " " + " ".join(f"{n}_sin {n}_cos" for n, _, _ in CYCLES)
       + " fw_sin fw_cos month_raw:i quarter:i",
       "SELECT region_id, day_idx, " + ", ".join(
           f"sin(2*pi()*{c}/{p}) {n}_sin, cos(2*pi()*{c}/{p}) {n}_cos" for n, c, p in CYCLES)
       + ", sin(2*pi()*(day_idx%5+1)/5) fw_sin, cos(2*pi()*(day_idx%5+1)/5) fw_cos,"
         " month AS month_raw, (month-1)//3+1 AS quarter FROM panel")
def cal_cyclic(spark, d):
    p = calendar_panel(spark, d)
    out = {}
    for n, c, period in CYCLES:
        out[f"{n}_sin"], out[f"{n}_cos"] = cal.cyclic(F.col(c), period)
    out["fw_sin"], out["fw_cos"] = cal.cyclic(F.col("day_idx") % 5 + 1, 5)
    out["month_raw"], out["quarter"] = F.col("month"), cal.quarter(F.col("month"))
    return p.withColumns(out)


@query("cal_season", KEYS + " season:s", """
SELECT region_id, day_idx, CASE WHEN month IN (12,1,2) THEN 'DJF' WHEN month < 6 THEN 'MAM'
  WHEN month < 9 THEN 'JJA' ELSE 'SON' END AS season FROM panel""")
def cal_season(spark, d):
    return calendar_panel(spark, d).withColumn("season", cal.season(F.col("month")))


@query("key_regionint", "region_id:s region_int:i", "SELECT DISTINCT region_id, nk AS region_int FROM panel")
def key_regionint(spark, d):
    ids = panel(spark, d).select("region_id").distinct()
    return ids.withColumn("region_int", cal.region_number(F.col("region_id")))


@query("key_regionmap", "region_id:s region_index:i", """
SELECT region_id, row_number() OVER (ORDER BY region_id) - 1 AS region_index
FROM (SELECT DISTINCT region_id FROM panel)""")
def key_regionmap(spark, d):
    return cal.dense_index(panel(spark, d))


@query("key_dayidx", "region_id:s date:s position:i",
       "SELECT region_id, date, row_number() OVER (PARTITION BY region_id ORDER BY ord) - 1 AS position FROM panel")
def key_dayidx(spark, d):
    """Position numbered from the calendar alone, without the adapter's own day index."""
    from panelcast.functions.chunks import with_position
    return with_position(calendar_panel(spark, d).drop("day_idx"), "region_id", "ord", "position", 732)


@query("cal_test_woy", "region_id:s test_woy:i", "SELECT region_id, test_woy FROM tmeta")
def cal_test_woy(spark, d):
    return gaps.test_meta(test(spark, d))


@query("cal_test_month", "region_id:s test_month:i end_month:i", "SELECT region_id, test_month, end_month FROM tmeta")
def cal_test_month(spark, d):
    return gaps.test_meta(test(spark, d))


@query("cal_test_meta",
       "region_id:s test_anchor_ord:i test_anchor_woy:i test_anchor_month:i test_anchor_doy:i",
       "SELECT region_id, test_ord AS test_anchor_ord, test_woy1 AS test_anchor_woy, "
       "end_month AS test_anchor_month, test_doy AS test_anchor_doy FROM tmeta")
def cal_test_meta(spark, d):
    return gaps.test_meta_struct(test(spark, d))


@query("gap_weeks", "region_id:s gap_approx gap_weeks gap_fixed366", """
SELECT s.region_id, ((sy-ey)*365 + (sm-em)*30 + (sd-ed))/7 gap_approx,
  coalesce(greatest(0, sg-eg)/7, 52) gap_weeks, (lo-eo)/7 gap_fixed366
FROM (SELECT region_id, min_by(year,day_idx) sy, min_by(month,day_idx) sm, min_by(day,day_idx) sd,
        min(gord) sg, max(ord) lo FROM test GROUP BY 1) s
LEFT JOIN (SELECT region_id, max_by(year,day_idx) ey, max_by(month,day_idx) em, max_by(day,day_idx) ed,
        max(gord) eg, max(ord) eo FROM gtrain GROUP BY 1) e USING (region_id)""".replace(
    "greatest(0, sg-eg)/7", "CASE WHEN eg IS NOT NULL THEN greatest(0, sg-eg)/7 END"))
def gap_weeks(spark, d):
    a, b = gapped_train(spark, d), test(spark, d)
    names = {"approx": "gap_approx", "gregorian": "gap_weeks", "fixed366": "gap_fixed366"}
    out = None
    for method, name in names.items():
        g = gaps.gap_weeks(a, b, method).withColumnRenamed("gap_weeks", name)
        out = g if out is None else out.join(g, "region_id", "full")
    return out


@query("gap_stratum", "region_id:s stratum:s",
       "SELECT region_id, CASE WHEN gap_weeks < 13 THEN 'short' ELSE 'long' END AS stratum FROM gap")
def gap_stratum(spark, d):
    g = gaps.gap_weeks(gapped_train(spark, d), test(spark, d))
    return g.withColumn("stratum", gaps.stratum(F.col("gap_weeks")))


@query("gap_bucket", "region_id:s bucket:s", """
SELECT region_id, CASE WHEN gap_weeks < 20 THEN '0-20w' WHEN gap_weeks < 40 THEN '20-40w'
  WHEN gap_weeks < 60 THEN '40-60w' WHEN gap_weeks < 80 THEN '60-80w' ELSE '80w+' END AS bucket FROM gap""")
def gap_bucket(spark, d):
    g = gaps.gap_weeks(gapped_train(spark, d), test(spark, d))
    return g.withColumn("bucket", gaps.gap_bucket(F.col("gap_weeks")))
