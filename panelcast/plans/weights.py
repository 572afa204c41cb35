"""Sample weights."""
from pyspark.sql import functions as F

from panelcast.operators import splits as sp, weights as wt
from panelcast.plans.base import query
from panelcast.plans.inputs import anchors
from panelcast.plans.splits import MDIST, meta

WK = "region_id:s week_idx:i "
SEV = "(1 + CAST(target_w1 > 0 AS INT) + 2*CAST(target_w1 >= 3 AS INT))"
SEV_B = "(1 + 0.5*CAST(target_w1 > 0 AS INT) + 3*CAST(target_w1 >= 3 AS INT))"
# A probability column to weigh by: the recent rain share of each week.
PROB = "(prec_sum/(prec_sum + 120))"
RATIO = f"least(greatest(p/(1-p), 0.25), 4) FROM (SELECT *, least(greatest({PROB}, 0.001), 0.999) AS p FROM anc)"


@query("wt_severity", WK + "plain unit", f"SELECT region_id, week_idx, {SEV} AS plain, {SEV_B}/avg({SEV_B}) OVER () AS unit FROM anc")
def wt_severity(spark, d):
    y = F.col("target_w1")
    df = anchors(spark, d).withColumns({"plain": wt.severity(y), "unit": wt.severity(y, 0.5, 3.0)})
    return wt.with_unit_mean(df, "unit")


@query("wt_step", WK + "w", "SELECT region_id, week_idx, CASE WHEN target_w1 >= 3 THEN 3 WHEN target_w1 > 0 THEN 1.5 ELSE 1 END AS w FROM anc")
def wt_step(spark, d):
    return anchors(spark, d).withColumn("w", wt.step(F.col("target_w1")))


MX = "greatest(target_w1, target_w2, target_w3, target_w4, target_w5)"


@query("wt_max_target", WK + "w", f"SELECT region_id, week_idx, 1 + CAST({MX} > 0 AS INT) + 2*CAST({MX} >= 3 AS INT) AS w FROM anc")
def wt_max_target(spark, d):
    return anchors(spark, d).withColumn("w", wt.max_target([f"target_w{h}" for h in range(1, 6)]))


@query("wt_season", WK + "w", f"""
SELECT region_id, week_idx, w/avg(w) OVER () AS w FROM (SELECT *, CASE WHEN {MDIST} <= 2 OR target_w1 >= 3 THEN 2.0 ELSE 1.0 END AS w
FROM anc JOIN tmeta USING (region_id))""")
def wt_season(spark, d):
    from panelcast.functions.calendar import circular_distance
    df = anchors(spark, d).join(meta(spark, d).select("region_id", "test_month"), "region_id", "left")
    near = F.coalesce(circular_distance(F.col("month"), F.col("test_month"), 12) <= 2, F.lit(False))
    return wt.with_unit_mean(df.withColumn("w", wt.season(near, F.col("target_w1"))), "w")


def weighted(spark, d):
    p = F.col("prec_sum") / (F.col("prec_sum") + 120)
    df = wt.with_unit_mean(anchors(spark, d).withColumn("av", wt.density_ratio(p)), "av")
    return df.withColumn("sev", wt.severity(F.col("target_w1")))


@query("wt_density", WK + "av", f"SELECT region_id, week_idx, w/avg(w) OVER () AS av FROM (SELECT region_id, week_idx, {RATIO.replace(' FROM', ' AS w FROM', 1)})")
def wt_density(spark, d):
    return weighted(spark, d)


COMBINED = f"""SELECT region_id, week_idx, av*sev/avg(av*sev) OVER () AS w FROM (
  SELECT region_id, week_idx, sev, w/avg(w) OVER () AS av FROM (SELECT region_id, week_idx, {SEV} AS sev, {RATIO.replace(' FROM', ' AS w FROM', 1)}))"""


@query("wt_combine", WK + "w", COMBINED)
def wt_combine(spark, d):
    df = weighted(spark, d).withColumn("w", wt.product([F.col("av"), F.col("sev")]))
    return wt.with_unit_mean(df, "w")


@query("wt_ess", "ess ess_share", f"SELECT pow(sum(w), 2)/sum(w*w) AS ess, pow(sum(w), 2)/sum(w*w)/count(w) AS ess_share FROM ({COMBINED})")
def wt_ess(spark, d):
    return wt.effective_size(wt_combine(spark, d), "w")
