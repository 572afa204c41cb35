"""Lags, leads, as-of scores, targets."""
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, HORIZONS, SCORE_LAGS
from panelcast.operators import asof, gaps, lags as lg, rolling as ro
from panelcast.plans.base import query
from panelcast.plans.inputs import anchors, gapped_train, test, train, weekly, weekly_test
from panelcast.plans.weekly import PREV, PREV_COLS, PREVFRAMES

T = [f"target_w{h}" for h in HORIZONS]
TI = " ".join(f"{t}:i" for t in T)
LAGS = lg.lag_columns()
O = "o AS (PARTITION BY region_id ORDER BY week_idx)"
LEADS = ", ".join(f"lead(score,{h}) OVER o AS target_w{h}" for h in HORIZONS)

LAG_SQL = ("SELECT region_id, week_idx, month, doy, " + ", ".join(f"coalesce({n}, 0) AS {n}" for n in [x[0] for x in LAGS] + PREV_COLS)
           + ", " + ", ".join(T) + " FROM (SELECT *, "
           + ", ".join(f"lag({c},{k},0) OVER o AS {n}" if k else f"{c} AS {n}" for n, c, k in LAGS)
           + f", {PREV}, {LEADS} FROM wk WINDOW {O}, {PREVFRAMES}) WHERE week_idx >= 12 AND target_w5 IS NOT NULL")


@query("lag_block", "region_id:s week_idx:i month:i doy:i " + " ".join(n for n, _, _ in LAGS) + " "
       + " ".join(PREV_COLS) + " " + TI, LAG_SQL)
def lag_block(spark, d):
    return lg.lag_matrix(weekly(spark, d))


@query("lead_targets", "region_id:s week_idx:i " + TI, f"SELECT region_id, week_idx, {', '.join(T)} FROM anc")
def lead_targets(spark, d):
    return anchors(spark, d)


@query("lead_targets_ragged_pos", f"region_id:s week_idx:i {TI} valid:b", f"""
SELECT *, target_w1 IS NOT NULL AND target_w2 IS NOT NULL AND target_w3 IS NOT NULL AND target_w4 IS NOT NULL
  AND target_w5 IS NOT NULL AS valid FROM (SELECT region_id, week_idx, {LEADS} FROM wk WINDOW {O})""")
def lead_targets_ragged_pos(spark, d):
    return lg.lead_targets(weekly(spark, d), ragged=True)


ORD_SQL = ("SELECT a.region_id, a.week_idx, a.month, a.doy366, a.woy1, a.ord, a.score, a.prec_sum, a.prec_mean, a.tmp_mean, "
           "a.tmp_max_mean, a.tmp_min_mean, a.humidity_mean, a.wb_tmp_mean, " + ", ".join(f"t{h}.score AS target_w{h}" for h in HORIZONS)
           + " FROM wk a " + " ".join(
               f"LEFT JOIN wk t{h} ON t{h}.region_id = a.region_id AND t{h}.ord = a.ord + {7 * h}" for h in HORIZONS)
           + " WHERE a.week_idx >= 12 AND coalesce(" + ", ".join(f"t{h}.score" for h in HORIZONS) + ") IS NOT NULL")


@query("join_targets_ord", f"region_id:s week_idx:i ord:i {TI}", ORD_SQL)
def join_targets_ord(spark, d):
    """Day numbers have a gap after 28 February of years without a 29th, so some targets stay null."""
    return lg.targets_by_ordinal(weekly(spark, d))


@query("anchor_last", "region_id:s week_idx:i month:i doy:i tmp_mean prec_sum",
       "SELECT region_id, week_idx, month, doy, tmp_mean, prec_sum FROM wtest "
       "QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY week_idx DESC) = 1")
def anchor_last(spark, d):
    w = weekly_test(spark, d).select("region_id", "week_idx", "month", "doy", "tmp_mean", "prec_sum")
    return lg.last_week(w)


@query("score_lags", "region_id:s week_idx:i " + " ".join(f"score_lag{k}:i" for k in SCORE_LAGS),
       "SELECT region_id, week_idx, " + ", ".join(f"lag(score,{k + 12},0) OVER o AS score_lag{k}" for k in SCORE_LAGS)
       + f" FROM wk WINDOW {O}")
def score_lags(spark, d):
    return lg.with_score_history(weekly(spark, d))


SINCE = """coalesce(week_idx - 12 - max(CASE WHEN score > 0 THEN week_idx END) OVER (PARTITION BY region_id ORDER BY week_idx
  ROWS BETWEEN 38 PRECEDING AND 13 PRECEDING), 26)"""


@query("since_nonzero", "region_id:s week_idx:i weeks_since_last_nonzero:i", """
SELECT region_id, week_idx, least(26, coalesce(week_idx - 12 - last_value(CASE WHEN score > 0 THEN week_idx END IGNORE NULLS)
  OVER (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 13 PRECEDING), 26))
  AS weeks_since_last_nonzero FROM wk""")
def since_nonzero(spark, d):
    return lg.with_score_history(weekly(spark, d))


@query("max_prev8", "region_id:s week_idx:i max_score_prev8:i", """
SELECT region_id, week_idx, coalesce(max(score) OVER (PARTITION BY region_id ORDER BY week_idx
  ROWS BETWEEN 20 PRECEDING AND 13 PRECEDING), 0) AS max_score_prev8 FROM wk""")
def max_prev8(spark, d):
    return lg.with_score_history(weekly(spark, d))


HIST = " ".join(f"{c}:i" for c in lg.SCORE_HISTORY)
LAST_SQL = ("SELECT region_id, " + ", ".join(f"coalesce(max(score) FILTER (344 - week_idx = {k}), 0) AS score_lag{k}" for k in SCORE_LAGS)
            + ", coalesce(min(344 - week_idx) FILTER (score > 0 AND 344 - week_idx <= 26), 26) AS weeks_since_last_nonzero"
              ", max(score) FILTER (344 - week_idx <= 8) AS max_score_prev8 FROM wk GROUP BY 1")


@query("last_score_features", f"region_id:s {HIST}", LAST_SQL)
def last_score_features(spark, d):
    return lg.last_score_history(weekly(spark, d))


@query("join_last_scores", f"region_id:s week_idx:i {HIST}", f"""
SELECT w.region_id, w.week_idx, {", ".join(f"coalesce({c}, 0) AS {c}" for c in lg.SCORE_HISTORY)} FROM wtest w
LEFT JOIN ({LAST_SQL}) h ON h.region_id = w.region_id""")
def join_last_scores(spark, d):
    known = lg.last_score_history(weekly(spark, d))
    return lg.join_score_history(weekly_test(spark, d).select("region_id", "week_idx"), known)


def targets(spark, d):
    """Training targets of the shortened history, with each region's gap."""
    t = gapped_train(spark, d)
    return asof.asof_scores(asof.window_ends(t), t, gaps.gap_weeks(t, test(spark, d)))


ENDS_SQL = """tg AS (SELECT region_id, day_idx AS target_pos, gord AS target_gord, score AS y, month, horizon,
    greatest(7, day_idx - (horizon*7 - 1)) AS window_end, gap_weeks
  FROM gtrain JOIN gap USING (region_id) CROSS JOIN (SELECT unnest([1,2,3,4,5]) horizon) WHERE score IS NOT NULL)"""
ASOF_SQL = f"""WITH {ENDS_SQL}, sc AS (SELECT region_id, day_idx, score, gord FROM gtrain WHERE score IS NOT NULL)
SELECT tg.*, sc.score AS last_score, coalesce(greatest(0, (target_gord - sc.gord)/7), CASE WHEN gap_weeks > 0 THEN gap_weeks ELSE 52 END) AS score_gap,
  (SELECT NULL) AS nothing
FROM tg ASOF LEFT JOIN sc ON tg.region_id = sc.region_id AND sc.day_idx < tg.window_end - CAST(floor(gap_weeks*7) AS BIGINT)"""
ASOF_SQL = ASOF_SQL.replace("coalesce(greatest(0, (target_gord - sc.gord)/7),",
                            "coalesce(CASE WHEN sc.gord IS NOT NULL THEN greatest(0, (target_gord - sc.gord)/7) END,")


@query("asof_gap", "region_id:s target_pos:i horizon:i score_gap", ASOF_SQL)
def asof_gap(spark, d):
    return targets(spark, d)


@query("hz_window", "region_id:s target_pos:i horizon:i window_end:i tmp_mean prec_sum", f"""
WITH {ENDS_SQL}, f AS (SELECT region_id, day_idx, avg(tmp) OVER w tmp_mean, coalesce(sum(prec) OVER w, 0) prec_sum FROM gtrain
  WINDOW w AS (PARTITION BY region_id ORDER BY day_idx ROWS BETWEEN 90 PRECEDING AND CURRENT ROW))
SELECT tg.*, tmp_mean, prec_sum FROM tg LEFT JOIN f ON f.region_id = tg.region_id AND f.day_idx = tg.window_end - 1""")
def hz_window(spark, d):
    """91-day window statistics at the position each horizon may see."""
    from panelcast.functions.blocks import rolling_stats
    t = gapped_train(spark, d)
    feats = rolling_stats(t, {"tmp_mean": ("tmp", "mean", 91), "prec_sum": ("prec", "sum", 91)})
    feats = feats.select("region_id", (F.col("day_idx") + 1).alias("window_end"), "tmp_mean", "prec_sum")
    return asof.window_ends(t).join(feats, ["region_id", "window_end"], "left")


@query("hz_explode", "region_id:s week_idx:i horizon:i y", """
SELECT region_id, week_idx, horizon, y FROM (SELECT region_id, week_idx, unnest([1,2,3,4,5]) horizon,
  unnest([target_w1,target_w2,target_w3,target_w4,target_w5]) y FROM (""" + ORD_SQL + ")) WHERE y IS NOT NULL")
def hz_explode(spark, d):
    return lg.explode_horizons(lg.targets_by_ordinal(weekly(spark, d)), ["region_id", "week_idx"])


@query("test_season_dist", "region_id:s week_idx:i month_dist:i in_season:i", """
SELECT region_id, week_idx, dist AS month_dist, CAST(dist <= 2 AS BIGINT) AS in_season FROM (
  SELECT w.region_id, w.week_idx, CASE WHEN test_month IS NULL THEN 3 ELSE least(abs(month-test_month), 12-abs(month-test_month)) END AS dist
  FROM wk w LEFT JOIN tmeta USING (region_id))""")
def test_season_dist(spark, d):
    meta = gaps.test_meta(test(spark, d))
    j = weekly(spark, d).join(meta.select("region_id", "test_month"), "region_id", "left")
    dist, flag = asof.season_distance(F.col("month"), F.coalesce("test_month", F.lit(0)))
    return j.select("region_id", "week_idx", dist.alias("month_dist"), flag.alias("in_season"))
