"""Splits, folds, samples, column choices."""
from pyspark.sql import functions as F

from panelcast.config import HORIZONS
from panelcast.operators import gaps, indices as ix, lags as lg, metrics, splits as sp, walkforward as wf
from panelcast.plans.base import query
from panelcast.plans.inputs import anchors, gapped_train, test, train, weekly, weekly_test
from panelcast.plans.lags import LAGS, ORD_SQL
from panelcast.plans.weekly import PREV_COLS

WK = "region_id:s week_idx:i "


def meta(spark, d):
    return gaps.test_meta(test(spark, d))


@query("split_fixed", WK + "part:s",
       "SELECT region_id, week_idx, CASE WHEN week_idx > 344-6-26 THEN 'val' ELSE 'train' END AS part FROM anc")
def split_fixed(spark, d):
    return sp.fixed_split(anchors(spark, d), 344, 26)


DIST = "least(abs(woy-test_woy), 52-abs(woy-test_woy))"
CALENDAR = f"""SELECT *, {DIST} AS woy_dist, CASE WHEN {DIST} <= 6 AND week_idx > max(week_idx) OVER (PARTITION BY region_id) - 52
  THEN 'val' ELSE 'train' END AS part FROM anc JOIN tmeta USING (region_id)"""


def calendar(spark, d):
    return sp.calendar_split(anchors(spark, d), meta(spark, d))


@query("split_calendar", WK + "woy_dist:i part:s", CALENDAR)
def split_calendar(spark, d):
    return calendar(spark, d)


@query("pick_closest", WK + "woy_dist:i", f"""
SELECT * FROM ({CALENDAR}) WHERE part = 'val'
QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY woy_dist, week_idx DESC) = 1""")
def pick_closest(spark, d):
    return sp.closest_row(calendar(spark, d).filter("part = 'val'").select("region_id", "week_idx", "woy_dist"))


BOUNDS = [250, 280, 310, 330]


@query("split_walkforward", WK + "boundary:i part:s", f"""
SELECT region_id, week_idx, boundary, CASE WHEN week_idx <= boundary THEN 'train' ELSE 'val' END AS part
FROM anc CROSS JOIN (SELECT unnest({BOUNDS}) boundary) WHERE week_idx <= boundary + 5""")
def split_walkforward(spark, d):
    return sp.walk_forward(anchors(spark, d).select("region_id", "week_idx"), BOUNDS)


SCORED = "boundary:i n:i " + " ".join(f"mae_w{h}" for h in HORIZONS) + " macro_mae avg_macro_mae last_macro_mae"


@query("split_walkforward_scores", SCORED, f"""
WITH l AS (SELECT region_id, week_idx, score, unnest([1,2,3,4,5]) horizon, unnest([target_w1,target_w2,target_w3,target_w4,target_w5]) truth FROM anc),
b AS (SELECT unnest({BOUNDS}) boundary),
f AS (SELECT boundary, horizon, regr_slope(truth, score) s, regr_intercept(truth, score) c FROM l JOIN b ON week_idx <= boundary GROUP BY 1, 2),
e AS (SELECT boundary, horizon, abs(least(greatest(c + s * score, 0), 5) - truth) e FROM f JOIN l USING (horizon) WHERE week_idx > boundary AND week_idx <= boundary + 5),
p AS (SELECT boundary, count(*) n, {", ".join(f"avg(e) FILTER (horizon = {h}) mae_w{h}" for h in HORIZONS)} FROM e GROUP BY 1),
m AS (SELECT *, ({" + ".join(f"mae_w{h}" for h in HORIZONS)}) / 5 AS macro_mae FROM p)
SELECT *, avg(macro_mae) OVER () avg_macro_mae, last_value(macro_mae) OVER (ORDER BY boundary ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) last_macro_mae FROM m""")
def split_walkforward_scores(spark, d):
    """Least squares on the current score, fitted up to each boundary and scored on the five weeks after it."""
    return wf.scores(anchors(spark, d), ["score"], BOUNDS, alpha=0.0)


def long_rows(spark, d):
    return metrics.long_targets(anchors(spark, d).select(
        "region_id", "week_idx", "ord", "month", *[f"target_w{h}" for h in HORIZONS]))


LONG = """SELECT region_id, week_idx, ord, month, unnest([1,2,3,4,5]) horizon,
  unnest([target_w1,target_w2,target_w3,target_w4,target_w5]) truth FROM anc"""


def purged_sql(n, gap, where=""):
    return f"""WITH x AS (SELECT *, row_number() OVER (ORDER BY ord, CAST(substr(region_id, 2) AS INT), horizon) - 1 AS p,
    count(*) OVER () // {n} AS block, min(ord) OVER () AS first_ord FROM ({LONG}) {where}),
  f AS (SELECT fold, (SELECT max(ord) FROM x WHERE p = fold * block) AS start FROM (SELECT unnest(range(1, {n})) fold))
SELECT region_id, week_idx, horizon, fold, CASE WHEN least({n - 1}, p // block) = fold THEN 'val' ELSE 'train' END AS part
FROM x CROSS JOIN f WHERE start - {gap} >= first_ord AND (least({n - 1}, p // block) = fold OR ord <= start - {gap})"""


@query("split_purged", WK + "horizon:i fold:i part:s", purged_sql(5, 91))
def split_purged(spark, d):
    return sp.purged_folds(long_rows(spark, d), 5, 91)


@query("split_purged_weeks", WK + "horizon:i fold:i part:s", purged_sql(4, 13 * 7, "WHERE horizon = 1"))
def split_purged_weeks(spark, d):
    """Four folds over anchors, purge of 13 weeks."""
    return sp.purged_folds(long_rows(spark, d).filter("horizon = 1"), 4, 13 * 7)


MDIST = "least(abs(month-test_month), 12-abs(month-test_month))"


@query("split_proxy_holdout", "region_id:s horizon:i week_idx:i", f"""
SELECT * FROM ({LONG}) JOIN tmeta USING (region_id) WHERE {MDIST} <= 2
QUALIFY row_number() OVER (PARTITION BY region_id, horizon ORDER BY ord DESC) = 1""")
def split_proxy_holdout(spark, d):
    return sp.latest_in_season(long_rows(spark, d), meta(spark, d))


@query("split_season_val", WK + "horizon:i fold:i", f"""
WITH v AS (SELECT *, {MDIST} <= 2 AS near, week_idx // 7 AS fold FROM ({LONG}) JOIN tmeta USING (region_id))
SELECT * FROM v WHERE near QUALIFY count(*) OVER (PARTITION BY fold) >= 20
UNION ALL SELECT * FROM v WHERE fold NOT IN (SELECT fold FROM v WHERE near GROUP BY 1 HAVING count(*) >= 20)""")
def split_season_val(spark, d):
    """Folds of seven weeks, most of them outside the season."""
    v = long_rows(spark, d).withColumn("fold", F.floor(F.col("week_idx") / 7))
    return sp.season_validation(v, meta(spark, d), ["fold"])


W53 = "least(abs(woy1-test_woy1), 53-abs(woy1-test_woy1))"
LASTW = "SELECT region_id, woy1 AS test_woy1, tmp_max_mean AS test_temp FROM wtest WHERE week_idx = 12"


def holdout_sql(order):
    return f"""WITH x AS (SELECT a.*, {W53} <= 6 AS near, test_temp, avg(prec_sum) OVER (PARTITION BY a.region_id) - prec_sum AS deficit
    FROM ({ORD_SQL}) a JOIN ({LASTW}) t USING (region_id)),
  v AS (SELECT region_id, ord AS vo FROM x QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY {order}) = 1)
SELECT x.*, CASE WHEN ord = vo THEN 'val' WHEN abs(ord - vo) < 91 THEN 'purged' ELSE 'train' END AS part FROM x JOIN v USING (region_id)"""


def ordinal_anchors(spark, d):
    return lg.targets_by_ordinal(weekly(spark, d))


def last_test_week(spark, d):
    return lg.last_week(weekly_test(spark, d))


@query("split_hot", WK + "part:s", holdout_sql("near DESC, deficit DESC, ord"))
def split_hot(spark, d):
    return sp.hot_holdout(ordinal_anchors(spark, d), last_test_week(spark, d))


@query("split_hot_temp", WK + "part:s",
       holdout_sql("near DESC, -abs(tmp_max_mean - (test_temp + 4)) DESC NULLS LAST, ord"))
def split_hot_temp(spark, d):
    return sp.hot_holdout(ordinal_anchors(spark, d), last_test_week(spark, d), "temp_match")


@query("split_leakfree", WK + "part:s", holdout_sql("near DESC, CASE WHEN near THEN -ord ELSE ord END"))
def split_leakfree(spark, d):
    return sp.season_holdout(ordinal_anchors(spark, d), last_test_week(spark, d))


def share_sql(keys, seed, buckets=1000):
    """The row's place 0 .. buckets - 1 by the leading hexadecimal digits of a digest of its key and the seed."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 12) AS BIGINT) % {buckets}"


def rank_sql(keys, seed):
    return f"substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 16)"


@query("split_random", "part:s n:i", f"""SELECT CASE WHEN {share_sql(["region_id", "week_idx"], 42)} < 100 THEN 'val' ELSE 'train' END AS part, count(*) n
FROM anc GROUP BY 1""")
def split_random(spark, d):
    return sp.random_split(anchors(spark, d), ["region_id", "week_idx"]).groupBy("part").agg(F.count("*").alias("n"))


@query("split_stratum", WK + "stratum:s", """
SELECT region_id, week_idx, coalesce(stratum, 'long') AS stratum FROM anc LEFT JOIN
  (SELECT region_id, CASE WHEN gap_weeks < 13 THEN 'short' ELSE 'long' END AS stratum FROM gap) USING (region_id)""")
def split_stratum(spark, d):
    g = gaps.gap_weeks(gapped_train(spark, d), test(spark, d))
    return sp.by_stratum(anchors(spark, d), g.select("region_id", gaps.stratum(F.col("gap_weeks")).alias("stratum")))


@query("filt_season_tail", "in_season:b n:i", f"""
SELECT dist <= 6 AS in_season, count(*) n FROM (SELECT region_id, week_idx, least(abs(woy - test_woy), 52 - abs(woy - test_woy)) AS dist FROM anc JOIN tmeta USING (region_id))
WHERE dist <= 6 OR {share_sql(["region_id", "week_idx"], 42)} < 200 GROUP BY 1""")
def filt_season_tail(spark, d):
    df = sp.with_woy_distance(anchors(spark, d), meta(spark, d))
    return sp.season_and_tail(df).groupBy((F.col("woy_dist") <= 6).alias("in_season")).agg(F.count("*").alias("n"))


def _totals(spark, d, cols):
    """Sum of every kept column of the lag matrix per anchor."""
    df = lg.lag_matrix(weekly(spark, d))
    one = df.agg(*[(F.sum(c) / F.count("*")).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column_name", "mean_value")


def _totals_sql(cols):
    lagged = {n: (c, k) for n, c, k in LAGS}
    exprs = ", ".join(f"avg(coalesce({n}, 0)) AS {n}" for n in cols)
    inner = ", ".join(f"lag({lagged[n][0]}, {lagged[n][1]}, 0) OVER o AS {n}" if lagged[n][1] else f"{lagged[n][0]} AS {n}" for n in cols)
    return f"""UNPIVOT (SELECT {exprs} FROM (SELECT region_id, week_idx, lead(score, 5) OVER o AS t5, {inner} FROM wk
      WINDOW o AS (PARTITION BY region_id ORDER BY week_idx)) WHERE week_idx >= 12 AND t5 IS NOT NULL)
    ON COLUMNS(*) INTO NAME column_name VALUE mean_value"""


ALL_LAGS = [n for n, _, _ in LAGS]
# An allowlist as a run would pass it: near lags, and no percentile columns.
ALLOWED = [n for n in ALL_LAGS if "_p95_" not in n and int(n.rsplit("lag", 1)[1]) <= 6]


@query("filt_feature_allow", "column_name:s mean_value:r", _totals_sql([n for n in ALL_LAGS if n in set(ALLOWED) or "_p95_" in n]))
def filt_feature_allow(spark, d):
    return _totals(spark, d, sp.allowed_columns(ALL_LAGS, ALLOWED))


@query("filt_lag0_meteo", "column_name:s mean_value:r", _totals_sql([n for n in ALL_LAGS if n.endswith("_lag0")]))
def filt_lag0_meteo(spark, d):
    return _totals(spark, d, sp.lag0_weather_columns(ALL_LAGS + PREV_COLS + ["anom_tmp_lag0", "month_sin"]))


@query("filt_lean", "column_name:s n_values:i", "SELECT unnest(['spi_4','spi_8','spi_12','vpd','dtr']) AS column_name, "
       "unnest([(SELECT count(*) - count(DISTINCT region_id) FROM wk), (SELECT count(*) - count(DISTINCT region_id) FROM wk), "
       "(SELECT count(*) - count(DISTINCT region_id) FROM wk), (SELECT count(tmp_mean - wb_tmp_mean) FROM wk), "
       "(SELECT count(tmp_max_mean - tmp_min_mean) FROM wk)]) AS n_values")
def filt_lean(spark, d):
    """Columns left of a frame of shift-carrying and other physical terms."""
    from panelcast.operators.rolling import weekly_frames
    w = weekly(spark, d)
    exprs = {**ix.deficits(), **ix.causal_spi(), "vpd": ix.vpd_dtr()["vpd"], "dtr": ix.vpd_dtr()["dtr"], **ix.region_anomalies(["tmp"])}
    df = weekly_frames(w.join(ix.region_base(w), "region_id"), exprs, 11)
    kept = sp.lean_columns(list(exprs))
    return df.agg(*[F.count(c).alias(c) for c in kept]).unpivot([], kept, "column_name", "n_values")


@query("samp_recent_bias", "region_id:s n:i oldest:i", f"""
SELECT region_id, count(*) n, min(day_idx) oldest FROM (SELECT * FROM (SELECT region_id, day_idx, count(*) OVER (PARTITION BY region_id) n,
    row_number() OVER (PARTITION BY region_id ORDER BY day_idx) - 1 AS pos FROM train WHERE score IS NOT NULL) WHERE n >= 10
  QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY CAST(pos < floor(n * (1 - 0.4)) AS INT), {rank_sql(["region_id", "day_idx"], 42)}) <= 200) GROUP BY 1""")
def samp_recent_bias(spark, d):
    s = sp.recent_biased(train(spark, d).filter("score is not null").select("region_id", "day_idx", "score"))
    return s.groupBy("region_id").agg(F.count("*").alias("n"), F.min("day_idx").alias("oldest"))


@query("samp_cap_region", "region_id:s n:i first:i", f"""SELECT region_id, count(*) n, min(week_idx) AS first FROM (SELECT region_id, week_idx FROM anc
  QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY {rank_sql(["region_id", "week_idx"], 42)}) <= 250) GROUP BY 1""")
def samp_cap_region(spark, d):
    return sp.capped_regions(anchors(spark, d).select("region_id", "week_idx")).groupBy("region_id").agg(
        F.count("*").alias("n"), F.min("week_idx").alias("first"))


@query("samp_tail_region", "region_id:s day_idx:i score:i", """
SELECT region_id, day_idx, score FROM train WHERE score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY day_idx DESC) <= 40""")
def samp_tail_region(spark, d):
    return sp.newest_scored(train(spark, d).select("region_id", "day_idx", "score"))


@query("samp_majority", "quiet:b n:i", f"""SELECT quiet, count(*) n FROM (SELECT *, greatest({", ".join(f"target_w{h}" for h in HORIZONS)}) = 0 AS quiet FROM anc)
WHERE NOT quiet OR {share_sql(["region_id", "week_idx"], 42)} < 500 GROUP BY 1""")
def samp_majority(spark, d):
    s = sp.thin_quiet(anchors(spark, d))
    quiet = F.greatest(*[f"target_w{h}" for h in HORIZONS]) == 0
    return s.groupBy(quiet.alias("quiet")).agg(F.count("*").alias("n"))


@query("set_region_overlap", "n_both:i n_only_train:i n_only_test:i", """
SELECT (SELECT count(*) FROM (SELECT region_id FROM train INTERSECT SELECT region_id FROM test)) n_both,
  (SELECT count(*) FROM (SELECT region_id FROM train EXCEPT SELECT region_id FROM test)) n_only_train,
  (SELECT count(*) FROM (SELECT region_id FROM test EXCEPT SELECT region_id FROM train)) n_only_test""")
def set_region_overlap(spark, d):
    return sp.region_overlap(train(spark, d), test(spark, d))


def _strategy(name, score):
    return f"""SELECT '{name}' AS strategy, * FROM x QUALIFY row_number() OVER (PARTITION BY region_id
      ORDER BY near DESC, CASE WHEN near THEN {score} END DESC NULLS LAST, ord) = 1"""


CAL = {"precip_deficit": "z_def", **{f"drought_stress_w{w}": f"z_def + {w}*z_tmax" for w in sp.STRESS_WEIGHTS}, "temp_only": "z_tmax"}


@query("sel_calibrate", "strategy:s n:i zero_mae mean_mae mean_beats_zero:b dist best:b", f"""
WITH b AS (SELECT a.*, {W53} <= 6 AS near, avg(prec_sum) OVER r AS pm, stddev_samp(prec_sum) OVER r AS ps,
    avg(tmp_max_mean) OVER r AS tm, stddev_samp(tmp_max_mean) OVER r AS ts, avg(score) OVER r AS region_mean
  FROM ({ORD_SQL}) a JOIN ({LASTW}) t USING (region_id) WINDOW r AS (PARTITION BY region_id)),
x AS (SELECT *, (pm - prec_sum)/CASE WHEN ps = 0 THEN 1 ELSE ps END AS z_def, (tmp_max_mean - tm)/CASE WHEN ts = 0 THEN 1 ELSE ts END AS z_tmax FROM b),
s AS ({" UNION ALL ".join(_strategy(n, e) for n, e in CAL.items())}),
m AS (SELECT strategy, count(*) n, ({"+".join(f"avg(target_w{h})" for h in HORIZONS)})/5 zero_mae,
  ({"+".join(f"avg(abs(region_mean - target_w{h}))" for h in HORIZONS)})/5 mean_mae FROM s GROUP BY 1),
q AS (SELECT *, mean_mae < zero_mae AS mean_beats_zero, sqrt(pow(zero_mae-1.2088, 2) + pow(mean_mae-0.9364, 2)) AS dist FROM m)
SELECT *, coalesce(mean_beats_zero AND dist = (SELECT min(dist) FROM q WHERE mean_beats_zero), false) AS best FROM q""")
def sel_calibrate(spark, d):
    return sp.calibrate_selection(ordinal_anchors(spark, d), last_test_week(spark, d))
