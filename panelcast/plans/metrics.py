"""Baselines, errors, reports."""
from pyspark.sql import functions as F

from panelcast.config import HORIZONS
from panelcast.operators import lags as lg, metrics as mt, splits as sp
from panelcast.plans.base import query
from panelcast.plans.inputs import anchors, clusters, members, weekly
from panelcast.plans.lags import ORD_SQL
from panelcast.plans.sources import PRED_SQL, _raw, predictions
from panelcast.plans.splits import holdout_sql, last_test_week, ordinal_anchors
from panelcast.sources import files

MAES = " ".join(f"mae_w{h}" for h in HORIZONS) + " macro_mae"
AE = "abs(pred - truth)"
MAE_SQL = ", ".join(f"avg({AE}) FILTER (horizon = {h}) AS mae_w{h}" for h in HORIZONS)
MACRO = "(" + " + ".join(f"avg({AE}) FILTER (horizon = {h})" for h in HORIZONS) + ")/5 AS macro_mae"


@query("base_preds", "region_id:s week_idx:i zero persistence region_mean", """
SELECT a.region_id, week_idx, 0 AS zero, score AS persistence, coalesce(r.m, g.m) AS region_mean FROM anc a
LEFT JOIN (SELECT region_id, avg(score) m FROM wk GROUP BY 1) r USING (region_id)
CROSS JOIN (SELECT avg(score) m FROM wk) g""")
def base_preds(spark, d):
    rows = anchors(spark, d).select("region_id", "week_idx", "score")
    known = weekly(spark, d)
    for kind in ("zero", "persistence", "region_mean"):
        rows = mt.baseline_predictions(kind, known, rows).withColumnRenamed("pred", kind)
    return rows


@query("met_macro", "member:s " + MAES, f"SELECT member, {MAE_SQL}, {MACRO} FROM mem GROUP BY 1")
def met_macro(spark, d):
    return mt.macro_mae(members(spark, d), ["member"])


RAGGED = "SELECT region_id, week_idx, horizon, truth, CAST(score AS DOUBLE) AS pred FROM (SELECT *, unnest([1,2,3,4,5]) horizon, unnest([target_w1,target_w2,target_w3,target_w4,target_w5]) truth FROM (" + ORD_SQL + ")) WHERE truth IS NOT NULL"


@query("met_macro_ragged", MAES, f"SELECT {MAE_SQL}, {MACRO} FROM ({RAGGED})")
def met_macro_ragged(spark, d):
    """Targets by day number, some of them unknown."""
    rows = mt.long_targets(ordinal_anchors(spark, d).select("region_id", "week_idx", "score", *lg.TARGETS))
    return mt.macro_mae(mt.baseline_predictions("persistence", rows, rows))


@query("met_full", "member:s horizon:i n:i mae rmse r2 bias p95_abs_error mase " + " ".join(f"mae_score{s}" for s in range(6)), f"""
WITH x AS (SELECT *, abs(truth - lag(truth) OVER (PARTITION BY member, horizon, region_id ORDER BY week_idx)) AS st FROM mem)
SELECT member, horizon, count(*) n, avg({AE}) mae, sqrt(avg(pow(pred-truth, 2))) rmse,
  1 - sum(pow(pred-truth, 2))/(var_pop(truth)*count(*)) r2, avg(pred-truth) bias, quantile_cont({AE}, 0.95) p95_abs_error,
  avg({AE})/greatest(avg(st), 1e-6) mase, {", ".join(f"avg({AE}) FILTER (truth = {s}) mae_score{s}" for s in range(6))}
FROM x GROUP BY 1, 2""")
def met_full(spark, d):
    return mt.full_metrics(members(spark, d), ["member", "horizon"])


@query("met_region", "member:s region_id:s n:i mae mean_true mean_pred",
       f"SELECT member, region_id, count(*) n, avg({AE}) mae, avg(truth) mean_true, avg(pred) mean_pred FROM mem GROUP BY 1, 2")
def met_region(spark, d):
    return mt.region_errors(members(spark, d), ["member"])


CLUSTER = f"""SELECT member, coalesce(region_cluster_id, -1) cluster_id, count(*) FILTER (horizon = 1) n_rows,
  count(DISTINCT region_id) n_regions, {MAE_SQL}, {MACRO} FROM mem LEFT JOIN clus USING (region_id) GROUP BY 1, 2"""


@query("met_cluster", "member:s cluster_id:i n_rows:i n_regions:i " + MAES, CLUSTER)
def met_cluster(spark, d):
    return mt.cluster_errors(members(spark, d), clusters(spark, d), ["member"])


@query("met_cluster_avg", "member:s cluster_mae macro_mae", f"""
SELECT member, c AS cluster_mae, macro_mae FROM (SELECT member, avg(macro_mae) c FROM ({CLUSTER}) WHERE cluster_id >= 0 GROUP BY 1)
JOIN (SELECT member, {MACRO} FROM mem GROUP BY 1) USING (member)""")
def met_cluster_avg(spark, d):
    m = members(spark, d)
    return mt.cluster_average(mt.cluster_errors(m, clusters(spark, d), ["member"]), m, ["member"])


BIAS_COLS = (" ".join(f"bias_w{h}" for h in HORIZONS) + " pred_mean true_mean mean_bias "
             + " ".join(f"mae_bucket_{b}" for b in mt.BUCKETS) + " frac_pred_low frac_true_zero n:i")
BIAS_SQL = ", ".join(f"avg(pred-truth) FILTER (horizon = {h}) bias_w{h}" for h in HORIZONS) + ", " + ", ".join(
    f"avg({AE}) FILTER (truth >= {lo} AND truth < {hi}) mae_bucket_{b}" for b, (lo, hi) in mt.BUCKETS.items()) + """,
  avg(pred) pred_mean, avg(truth) true_mean, avg(pred) - avg(truth) mean_bias, avg(CAST(pred <= 0.5 AS INT)) frac_pred_low,
  avg(CAST(truth <= 0.5 AS INT)) frac_true_zero, count(*) n"""


@query("met_bias", "member:s " + MAES + " " + BIAS_COLS, f"SELECT member, {MAE_SQL}, {MACRO}, {BIAS_SQL} FROM mem GROUP BY 1")
def met_bias(spark, d):
    return mt.bias_report(members(spark, d), ["member"])


@query("met_fold", "member:s mean std min max cv_stability", f"""
SELECT member, avg(mae) mean, stddev_pop(mae) std, min(mae) AS min, max(mae) AS max, stddev_pop(mae)/avg(mae) cv_stability
FROM (SELECT member, week_idx//70 AS fold, avg({AE}) mae FROM mem GROUP BY 1, 2) GROUP BY 1""")
def met_fold(spark, d):
    folds = members(spark, d).groupBy("member", F.floor(F.col("week_idx") / 70).alias("fold")).agg(F.avg(mt.error()).alias("mae"))
    return mt.fold_summary(folds, by=["member"])


@query("met_monotone", "member:s horizon:i mae previous drops:b", f"""
SELECT member, horizon, mae, previous, coalesce(previous > mae + 0.05, false) AS drops FROM (
  SELECT *, lag(mae) OVER (PARTITION BY member ORDER BY horizon) AS previous FROM (
    SELECT member, horizon, avg({AE}) mae FROM mem GROUP BY 1, 2))""")
def met_monotone(spark, d):
    return mt.horizon_drops(mt.macro_mae(members(spark, d), ["member"]))


@query("rep_describe", "column_name:s count mean std min p25 p50 p75 max", " UNION ALL ".join(f"""
SELECT 'pred_week{h}' AS column_name, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.25) p25,
  quantile_cont(x, 0.5) p50, quantile_cont(x, 0.75) p75, max(x) AS max FROM (SELECT pred_week{h} AS x FROM (
  {PRED_SQL.format(cols=", ".join(f"{_raw[k]} pred_week{k}" for k in HORIZONS))}))""" for h in HORIZONS))
def rep_describe(spark, d):
    return mt.describe(files.prediction_table(predictions(spark, d)), [f"pred_week{h}" for h in HORIZONS])


@query("rep_profile", "member:s mean week1 week5 decay frac_low pct_severe median", """
SELECT member, avg(pred) mean, avg(pred) FILTER (horizon = 1) week1, avg(pred) FILTER (horizon = 5) week5,
  avg(pred) FILTER (horizon = 1) - avg(pred) FILTER (horizon = 5) decay, avg(CAST(pred < 0.5 AS INT)) frac_low,
  100*avg(CAST(pred >= 3 AS INT)) pct_severe, quantile_cont(pred, 0.5) median FROM mem GROUP BY 1""")
def rep_profile(spark, d):
    return mt.prediction_profile(members(spark, d), ["member"])


@query("rep_compare", "n:i max_abs mean_abs corr", """
SELECT count(*) n, max(abs(p_a-p_c)) max_abs, avg(abs(p_a-p_c)) mean_abs, corr(p_a, p_c) AS corr FROM al""")
def rep_compare(spark, d):
    m = members(spark, d)
    return mt.compare_predictions(m.filter("member = 'a'"), m.filter("member = 'c'"))


KINDS = {"zero": "0.0", "persistence": "CAST(score AS DOUBLE)", "region_mean": "rm"}
HOLD = holdout_sql("near DESC, deficit DESC, ord")


@query("rep_baselines", "kind:s leaderboard_gap " + MAES + " " + BIAS_COLS, f"""
WITH h AS ({HOLD}), rm AS (SELECT region_id, avg(score) rm FROM h WHERE part = 'train' GROUP BY 1),
v AS (SELECT *, unnest([1,2,3,4,5]) horizon, unnest([target_w1,target_w2,target_w3,target_w4,target_w5]) truth FROM h JOIN rm USING (region_id) WHERE part = 'val'),
z AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, horizon, truth, {e} AS pred FROM v WHERE truth IS NOT NULL" for k, e in KINDS.items())})
SELECT *, macro_mae - CASE kind WHEN 'zero' THEN 1.2088 WHEN 'region_mean' THEN 0.9364 END AS leaderboard_gap
FROM (SELECT kind, {MAE_SQL}, {BIAS_SQL} FROM z GROUP BY 1)
JOIN (SELECT kind, avg(m) AS macro_mae FROM (SELECT kind, horizon, avg({AE}) m FROM z GROUP BY 1, 2) GROUP BY 1) USING (kind)""")
def rep_baselines(spark, d):
    """The three baselines on the dry holdout and their distance to the published errors."""
    h = sp.hot_holdout(ordinal_anchors(spark, d), last_test_week(spark, d))
    pool, val = h.filter("part = 'train'"), h.filter("part = 'val'").select("region_id", "score", *lg.TARGETS)
    out = None
    for kind in KINDS:
        rows = mt.long_targets(mt.baseline_predictions(kind, pool, val)).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    known = F.when(F.col("kind") == "zero", sp.ZERO_TARGET).when(F.col("kind") == "region_mean", sp.MEAN_TARGET)
    return mt.bias_report(out, ["kind"]).withColumn("leaderboard_gap", F.col("macro_mae") - known)
