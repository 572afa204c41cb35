"""Climatology, baselines and anomalies."""
from pyspark.sql import functions as F

from panelcast.config import ANOMALY_CHANNELS, CHANNELS, ROLL_DAYS
from panelcast.functions.blocks import rolling_stats
from panelcast.operators import climatology as cl, gaps, indices as ix
from panelcast.operators.rolling import weekly_frames
from panelcast.plans.base import query
from panelcast.plans.inputs import test, train, weekly
from panelcast.plans.weekly import DAYFRAMES, WEEKFRAMES

Z = "avg(CAST(score = 0 AS INT))"
RS = f"SELECT region_id, avg(score) m, stddev_samp(score) s, {Z} z FROM wk GROUP BY 1"


@query("clim_region", "region_id:s week_idx:i region_id_int:i region_score_mean region_score_std region_zero_rate", f"""
SELECT region_id, week_idx, CAST(substr(region_id, 2) AS BIGINT) AS region_id_int, m AS region_score_mean,
  coalesce(s, 0) AS region_score_std, z AS region_zero_rate FROM wk LEFT JOIN ({RS}) USING (region_id)""")
def clim_region(spark, d):
    w = weekly(spark, d).select("region_id", "week_idx", "score")
    return cl.with_region_stats(w.drop("score"), cl.region_stats(w))


WOY = f"""SELECT region_id, woy, avg(score) region_woy_score_mean, coalesce(stddev_samp(score), 0) region_woy_score_std,
  max(score) region_woy_score_max, quantile_cont(score, 0.9) region_woy_score_p90, {Z} region_woy_zero_rate FROM wk """
WOY_COLS = list(cl.WOY_SCORE)


@query("clim_woy_score", "region_id:s woy:i " + " ".join(WOY_COLS), WOY + "GROUP BY 1, 2")
def clim_woy_score(spark, d):
    return cl.woy_score(weekly(spark, d))


def _median_filled(cols, src):
    return ("SELECT j.* REPLACE (" + ", ".join(f"coalesce(j.{c}, m.m_{c}) AS {c}" for c in cols)
            + f") FROM ({src}) j CROSS JOIN (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) m_{c}" for c in cols) + f" FROM ({src})) m")


WOY_JOIN = _median_filled(WOY_COLS, f"SELECT w.*, {', '.join(WOY_COLS)} FROM wk w LEFT JOIN ({WOY} GROUP BY 1, 2) USING (region_id, woy)")


@query("clim_woy_join", "region_id:s week_idx:i " + " ".join(WOY_COLS), WOY_JOIN)
def clim_woy_join(spark, d):
    w = weekly(spark, d)
    return cl.join_woy_score(w.select("region_id", "week_idx", "woy"), cl.woy_score(w))


METEO = ("SELECT region_id, woy, " + ", ".join(f"avg({c}_mean) clim_{c}_mean" for c in ANOMALY_CHANNELS) + ", "
         + ", ".join(f"greatest(coalesce(stddev_samp({c}_mean), 1e-3), 1e-3) clim_{c}_std" for c in ANOMALY_CHANNELS) + " FROM wk ")
METEO_COLS = [f"clim_{c}_{s}" for s in ("mean", "std") for c in ANOMALY_CHANNELS]


@query("clim_woy_meteo", "region_id:s woy:i " + " ".join(METEO_COLS), METEO + "GROUP BY 1, 2")
def clim_woy_meteo(spark, d):
    return cl.woy_meteo(weekly(spark, d))


ANOM_JOIN = _median_filled(METEO_COLS[:6], "SELECT w.*, " + ", ".join(METEO_COLS)
                           + f" FROM wk w LEFT JOIN ({METEO} GROUP BY 1, 2) USING (region_id, woy)")


@query("anom_woy", "region_id:s week_idx:i " + " ".join(f"anom_{c}:r" for c in ANOMALY_CHANNELS),
       "SELECT region_id, week_idx, " + ", ".join(
           f"({c}_mean - clim_{c}_mean)/greatest(coalesce(clim_{c}_std, 1e-3), 1e-3) AS anom_{c}" for c in ANOMALY_CHANNELS)
       + f" FROM ({ANOM_JOIN})")
def anom_woy(spark, d):
    w = weekly(spark, d)
    return cl.woy_anomalies(w, cl.woy_meteo(w), suffix="_mean")


BASE = ", ".join(f"avg({c}) {c}_mu, stddev_samp({c}) {c}_sd" for c in CHANNELS)


@query("clim_region_meteo", "region_id:s " + " ".join(f"{c}_mu {c}_sd" for c in CHANNELS),
       f"SELECT region_id, {BASE} FROM train GROUP BY 1")
def clim_region_meteo(spark, d):
    return cl.region_meteo(train(spark, d))


MONTHLY = "SELECT region_id, month, " + ", ".join(f"avg({c}) {c}_mo_mean" for c in CHANNELS) + " FROM train "


@query("clim_region_month", "region_id:s month:i " + " ".join(f"{c}_mo_mean" for c in CHANNELS), MONTHLY + "GROUP BY 1, 2")
def clim_region_month(spark, d):
    return cl.region_month_meteo(train(spark, d))


PROFILE = """SELECT region_id, avg(score) reg_mean, stddev_samp(score) reg_std, quantile_cont(score, 0.25) reg_q25,
  quantile_cont(score, 0.75) reg_q75, quantile_cont(score, 0.9) reg_q90, avg(CAST(score > 0 AS INT)) reg_nonzero
  FROM train WHERE score IS NOT NULL GROUP BY 1"""


@query("clim_score_profile", "region_id:s " + " ".join(cl.PROFILE), PROFILE)
def clim_score_profile(spark, d):
    return cl.score_profile(train(spark, d))


@query("clim_last_score", "region_id:s last_score:i last_gord:i", """
SELECT region_id, max_by(score, day_idx) last_score, max(gord) last_gord FROM gtrain WHERE score IS NOT NULL GROUP BY 1""")
def clim_last_score(spark, d):
    from panelcast.plans.inputs import gapped_train
    return cl.last_score(gapped_train(spark, d))


@query("clim_month_score", "region_id:s week_idx:i horizon:i reg_score_mo_mean fw_score_mo_mean", """
WITH mo AS (SELECT region_id, month, avg(score) v FROM wk GROUP BY 1, 2),
  rm AS (SELECT region_id, avg(score) m FROM wk GROUP BY 1)
SELECT w.region_id, w.week_idx, h.horizon, coalesce(a.v, m) reg_score_mo_mean, coalesce(b.v, m) fw_score_mo_mean
FROM wk w CROSS JOIN (SELECT unnest([1,2,3,4,5]) horizon) h JOIN rm USING (region_id)
LEFT JOIN mo a ON a.region_id = w.region_id AND a.month = w.month
LEFT JOIN mo b ON b.region_id = w.region_id AND b.month = (w.month - 1 + (h.horizon-1)//4) % 12 + 1""")
def clim_month_score(spark, d):
    w = weekly(spark, d).select("region_id", "week_idx", "month", "score")
    rows = w.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return cl.with_month_scores(rows, cl.month_score(w), cl.score_stats(w, ["region_id"], {"reg_mean": "mean"}))


ANOM_CH = CHANNELS
SD = lambda c: f"CASE WHEN {c}_sd IS NULL OR {c}_sd < 1e-6 THEN 1 ELSE {c}_sd END"


@query("anom_window", "region_id:s day_idx:i " + " ".join(f"{c}_anom_{w}d" for w in ROLL_DAYS for c in ANOM_CH),
       "SELECT region_id, day_idx, " + ", ".join(f"({c}_mean_{w}d - {c}_mu)/({SD(c)}) AS {c}_anom_{w}d" for w in ROLL_DAYS for c in ANOM_CH)
       + " FROM (SELECT region_id, day_idx, " + ", ".join(f"avg({c}) OVER w{w} AS {c}_mean_{w}d" for w in ROLL_DAYS for c in ANOM_CH)
       + f" FROM train WINDOW {DAYFRAMES}) JOIN (SELECT region_id, {BASE} FROM train GROUP BY 1) USING (region_id)")
def anom_window(spark, d):
    t = train(spark, d)
    rows = rolling_stats(t.select("region_id", "day_idx", *ANOM_CH),
                         {f"{c}_mean_{w}d": (c, "mean", w) for w in ROLL_DAYS for c in ANOM_CH})
    return cl.window_anomalies(rows, cl.region_meteo(t), ANOM_CH, ROLL_DAYS)


@query("anom_month", "region_id:s day_idx:i " + " ".join(f"{c}_mo_anom_7d" for c in CHANNELS),
       "SELECT region_id, day_idx, " + ", ".join(f"coalesce(({c}_mean_7d - {c}_mo_mean)/({SD(c)}), 0) AS {c}_mo_anom_7d" for c in CHANNELS)
       + " FROM (SELECT region_id, day_idx, month, " + ", ".join(f"avg({c}) OVER w7 AS {c}_mean_7d" for c in CHANNELS)
       + f" FROM train WINDOW {DAYFRAMES}) JOIN (SELECT region_id, {BASE} FROM train GROUP BY 1) USING (region_id) "
       + f"LEFT JOIN ({MONTHLY} GROUP BY 1, 2) USING (region_id, month)")
def anom_month(spark, d):
    t = train(spark, d)
    rows = rolling_stats(t, {f"{c}_mean_7d": (c, "mean", 7) for c in CHANNELS}).drop(*CHANNELS)
    return cl.month_anomalies(rows, cl.region_month_meteo(t), cl.region_meteo(t), CHANNELS)


@query("scal_region", "region_id:s week_idx:i " + " ".join(cl.SCALARS), f"""
SELECT w.region_id, w.week_idx, coalesce(r.m, g.m) region_score_mean, coalesce(r.s, g.s) region_score_std,
  coalesce(r.z, g.z) region_zero_rate, coalesce(r.p, g.p) region_score_p90
FROM wk w LEFT JOIN (SELECT region_id, avg(score) m, coalesce(stddev_samp(score), 0) s, {Z} z, quantile_cont(score, 0.9) p
  FROM wk GROUP BY 1) r USING (region_id)
CROSS JOIN (SELECT avg(score) m, stddev_samp(score) s, {Z} z, quantile_cont(score, 0.9) p FROM wk) g""")
def scal_region(spark, d):
    w = weekly(spark, d).select("region_id", "week_idx", "month", "score")
    return cl.region_scalars(w.drop("score"), w)


@query("scal_season", "region_id:s week_idx:i region_month_score_mean region_month_score_std", f"""
WITH pool AS (SELECT * FROM wk)
SELECT w.region_id, w.week_idx, coalesce(c.m, r.m, g.m) region_month_score_mean, coalesce(c.s, r.s, g.s) region_month_score_std
FROM wk w LEFT JOIN (SELECT region_id, month, avg(score) m, coalesce(stddev_samp(score), 0) s FROM pool GROUP BY 1, 2) c USING (region_id, month)
LEFT JOIN (SELECT region_id, avg(score) m, coalesce(stddev_samp(score), 0) s FROM pool GROUP BY 1) r USING (region_id)
CROSS JOIN (SELECT avg(score) m, stddev_samp(score) s FROM pool) g""")
def scal_season(spark, d):
    w = weekly(spark, d).select("region_id", "week_idx", "month", "score")
    return cl.season_scalars(w.drop("score"), w)


BM = [f"{c}_mean" for c in CHANNELS] + ["prec_sum"]
BASE_SQL = "SELECT region_id, " + ", ".join(f"avg({c}) {c}_bmean, coalesce(stddev_samp({c}), 0) {c}_bstd" for c in BM) + " FROM wk GROUP BY 1"


@query("base_region", "region_id:s " + " ".join(f"{c}_bmean {c}_bstd" for c in BM), BASE_SQL)
def base_region(spark, d):
    return ix.region_base(weekly(spark, d))


@query("anom_region", "region_id:s week_idx:i " + " ".join(f"{c}_ranom{w}" for w in (4, 8, 12) for c in CHANNELS),
       "SELECT region_id, week_idx, " + ", ".join(
           f"(avg({c}_mean) OVER w{w} - {c}_mean_bmean)/({c}_mean_bstd + 1e-6) AS {c}_ranom{w}" for w in (4, 8, 12) for c in CHANNELS)
       + f" FROM wk JOIN ({BASE_SQL}) USING (region_id) WINDOW {WEEKFRAMES}")
def anom_region(spark, d):
    w = weekly(spark, d)
    return weekly_frames(w.join(ix.region_base(w), "region_id", "left"), ix.region_anomalies(), 11)


@query("anom_local", "region_id:s week_idx:i " + " ".join(f"{c}_anom_sl {c}_anom_z" for c in CHANNELS),
       "SELECT region_id, week_idx, " + ", ".join(
           f"avg({c}_mean) OVER w4 - avg({c}_mean) OVER w12 AS {c}_anom_sl, CASE WHEN count({c}_mean) OVER w12 >= 2 AND stddev_samp({c}_mean) OVER w12 > 0 "
           f"THEN ({c}_mean - avg({c}_mean) OVER w12)/(stddev_samp({c}_mean) OVER w12 + 1e-6) "
           f"WHEN count({c}_mean) OVER w12 >= 2 THEN ({c}_mean - avg({c}_mean) OVER w12)/1e-6 END AS {c}_anom_z" for c in CHANNELS)
       + f" FROM wk WINDOW {WEEKFRAMES}")
def anom_local(spark, d):
    return weekly_frames(weekly(spark, d), ix.local_anomalies(), 11)


@query("spi_woy", "region_id:s week_idx:i spi", """
SELECT region_id, week_idx, (prec_sum - avg(prec_sum) OVER c)/CASE WHEN stddev_samp(prec_sum) OVER c = 0 THEN 1
  ELSE stddev_samp(prec_sum) OVER c END AS spi FROM wk WINDOW c AS (PARTITION BY region_id, woy1)""")
def spi_woy(spark, d):
    return cl.week_spi(weekly(spark, d))


@query("prof_month", "region_id:s month:i " + " ".join(c if c != "mo_count" else c + ":i" for c in cl.MONTH)
       + " reg_mean intra_std mo_mean_diff", """
WITH c AS (SELECT region_id, month, avg(score) mo_mean, stddev_samp(score) mo_std, quantile_cont(score, 0.25) mo_q25,
    quantile_cont(score, 0.5) mo_median, quantile_cont(score, 0.75) mo_q75, quantile_cont(score, 0.9) mo_q90,
    avg(CAST(score > 0 AS INT)) mo_nonzero, avg(CAST(score >= 3 AS INT)) mo_severe, count(score) mo_count
  FROM train WHERE score IS NOT NULL GROUP BY 1, 2)
SELECT c.*, reg_mean, intra_std, mo_mean - reg_mean AS mo_mean_diff FROM c
JOIN (SELECT region_id, avg(score) reg_mean FROM train GROUP BY 1) USING (region_id)
JOIN (SELECT region_id, stddev_samp(mo_mean) intra_std FROM c GROUP BY 1) USING (region_id)""")
def prof_month(spark, d):
    return cl.month_profile(train(spark, d))


PRIOR = ["n_obs:i", "mo_mean", "mo_std", "mo_q25", "mo_q50", "mo_q75", "mo_q90", "mo_nonzero", "mo_severe"]


@query("prior_test_month", "region_id:s test_month:i " + " ".join(PRIOR) + " reg_mean", """
WITH s AS (SELECT t.region_id, score, month, test_month, count(*) FILTER (month = test_month) OVER (PARTITION BY t.region_id) n
  FROM train t JOIN tmeta USING (region_id) WHERE score IS NOT NULL),
k AS (SELECT * FROM s WHERE n < 3 OR month = test_month)
SELECT region_id, test_month, count(*) n_obs, avg(score) mo_mean, stddev_pop(score) mo_std, quantile_cont(score, 0.25) mo_q25,
  quantile_cont(score, 0.5) mo_q50, quantile_cont(score, 0.75) mo_q75, quantile_cont(score, 0.9) mo_q90,
  avg(CAST(score > 0 AS INT)) mo_nonzero, avg(CAST(score >= 3 AS INT)) mo_severe, any_value(reg_mean) reg_mean
FROM k JOIN (SELECT region_id, avg(score) reg_mean FROM s GROUP BY 1) USING (region_id) GROUP BY 1, 2""")
def prior_test_month(spark, d):
    return cl.test_month_prior(train(spark, d), gaps.test_meta(test(spark, d)))
