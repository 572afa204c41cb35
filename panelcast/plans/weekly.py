"""Daily to weekly, rolling windows, decomposition, sequences."""
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, ROLL_DAYS, SLOPE_CHANNELS, STATS
from panelcast.operators import rolling as ro, sequences as sq, weekly as wk
from panelcast.plans.base import query
from panelcast.plans.cleaning import IMPUTED, imputed
from panelcast.plans.inputs import test, train, weekly
from panelcast.plans.prefix import PREFIX, WEEK_COLS, stat_sql, weekly_sql

META = "month:i doy:i"


def frame_stat(c, stat):
    return stat_sql(c, stat).replace(")", ") OVER w", 1) if stat != "sum" else f"coalesce(sum({c}) OVER w, 0)"


W7 = "WINDOW w AS (PARTITION BY region_id ORDER BY day_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query("wk_anchor", f"region_id:s week_idx:i {META} score:i " + " ".join(WEEK_COLS),
       "SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY day_idx) - 1 AS week_idx FROM ("
       "SELECT region_id, day_idx, month, doy, score, "
       + ", ".join(f"{frame_stat(c, s)} AS {c}_{s}" for c in CHANNELS for s in STATS)
       + f" FROM train {W7}) WHERE score IS NOT NULL")
def wk_anchor(spark, d):
    return wk.weekly_at_anchors(train(spark, d))


@query("wk_block", f"region_id:s week_idx:i {META} " + " ".join(WEEK_COLS),
       "SELECT region_id, week_idx, month, doy, " + ", ".join(WEEK_COLS) + " FROM wtest")
def wk_block(spark, d):
    """Thirteen fixed blocks of the test part."""
    return wk.weekly_blocks(test(spark, d))


BACK = ["mean", "std", "min", "max", "sum"]
FULL = lambda c, s: f"CASE WHEN count({c}) = 7 THEN {stat_sql(c, s)} END AS {c}_{s}"


@query("wk_back", f"region_id:s week_idx:i {META} " + " ".join(f"{c}_{s}" for c in CHANNELS for s in BACK),
       "SELECT region_id, 12 - (90 - day_idx)//7 AS week_idx, max_by(month, day_idx) AS month, max_by(doy, day_idx) AS doy, "
       + ", ".join(FULL(c, s) for c in CHANNELS for s in BACK)
       + " FROM test GROUP BY region_id, (90 - day_idx)//7 HAVING count(*) = 7")
def wk_back(spark, d):
    return wk.weekly_blocks_back(test(spark, d))


@query("wk_strict", f"region_id:s week_idx:i {META} score:i " + " ".join(f"{c}_{s}" for c in CHANNELS for s in BACK),
       "SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY day_idx) - 1 AS week_idx, month, doy, score, "
       + ", ".join(f"{c}_{s}" for c in CHANNELS for s in BACK) + " FROM (SELECT region_id, day_idx, month, doy, score, "
       "count(*) OVER w AS rows_, "
       + ", ".join(f"CASE WHEN count({c}) OVER w = 7 THEN {frame_stat(c, s)} END AS {c}_{s}" for c in CHANNELS for s in BACK)
       + f" FROM train {W7}) WHERE score IS NOT NULL AND rows_ = 7")
def wk_strict(spark, d):
    return wk.weekly_at_anchors(train(spark, d), stats=BACK, strict=True)


CH15 = [f"{c}_mean" for c in CHANNELS] + ["surf_pre_drop", "surf_pre_climb", "surf_pre_std", "prec_max",
                                          "prec_dry_count", "tmp_max_peak"]
CH15_SQL = """SELECT region_id, week_idx, {means}, greatest(-min(d3), 0) surf_pre_drop, greatest(max(d3), 0) surf_pre_climb,
  stddev_pop(surf_pre) surf_pre_std, max(prec) prec_max, count(*) FILTER (prec < 1) prec_dry_count, max(tmp_max) tmp_max_peak,
  max_by(month, day_idx) AS month, max_by(doy, day_idx) AS doy, max(score) AS score
FROM (SELECT *, day_idx//7 AS week_idx, surf_pre - lag(surf_pre, 3) OVER (PARTITION BY region_id, day_idx//7 ORDER BY day_idx) AS d3
      FROM ({src})) GROUP BY 1, 2""".format(means=", ".join(f"avg({c}) AS {c}_mean" for c in CHANNELS), src=IMPUTED)


@query("wk_channels15", "region_id:s week_idx:i doy:i " + " ".join(CH15), CH15_SQL)
def wk_channels15(spark, d):
    return wk.weekly_channels(imputed(spark, d))


def _roll_cols():
    out = {}
    for w in ROLL_DAYS:
        for c in CHANNELS:
            for s in ["mean", "std"] + (["min", "max", "p95"] if w <= 21 else []):
                out[f"{c}_{s}_{w}d"] = (c, s, w)
    return out


ROLLS = _roll_cols()
DAYFRAMES = ", ".join(f"w{w} AS (PARTITION BY region_id ORDER BY day_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
                      for w in ROLL_DAYS)


@query("roll_multi", "region_id:s day_idx:i " + " ".join(ROLLS),
       "SELECT region_id, day_idx, " + ", ".join(
           frame_stat(c, s).replace("OVER w", f"OVER w{w}") + f" AS {n}" for n, (c, s, w) in ROLLS.items())
       + f" FROM train WINDOW {DAYFRAMES}")
def roll_multi(spark, d):
    return ro.roll_days(train(spark, d))


SLOPES = {f"{c}_slope_{w}d": (c, w) for w in ROLL_DAYS for c in SLOPE_CHANNELS}


@query("roll_slope", "region_id:s day_idx:i " + " ".join(SLOPES),
       "SELECT region_id, day_idx, " + ", ".join(
           f"CASE WHEN count({c}) OVER w{w} > 2 THEN regr_slope({c}, day_idx) OVER w{w} ELSE 0 END AS {n}"
           for n, (c, w) in SLOPES.items()) + f" FROM train WINDOW {DAYFRAMES}")
def roll_slope(spark, d):
    return ro.roll_slopes(train(spark, d))


MEANS = {c: f"{c}_mean" for c in CHANNELS}
WEEKFRAMES = ", ".join(f"w{w} AS (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
                       for w in (4, 8, 12, 26, 52))


@query("roll_wk", "region_id:s week_idx:i " + " ".join(f"{c}_roll{w}_{s}" for w in (4, 8, 12) for c in CHANNELS for s in ("mean", "std")),
       "SELECT region_id, week_idx, " + ", ".join(
           f"avg({c}_mean) OVER w{w} AS {c}_roll{w}_mean, CASE WHEN count({c}_mean) OVER w{w} >= 2 THEN "
           f"stddev_samp({c}_mean) OVER w{w} END AS {c}_roll{w}_std" for w in (4, 8, 12) for c in CHANNELS)
       + f" FROM wk WINDOW {WEEKFRAMES}")
def roll_wk(spark, d):
    return ro.weekly_frames(weekly(spark, d), ro.rolling_weeks(MEANS), 11)


PREV = ", ".join(f"avg({c}_mean) OVER p4 AS {c}_mean_roll4, max({c}_mean) OVER p4 AS {c}_max_roll4, "
                 f"stddev_pop({c}_mean) OVER p4 AS {c}_std_roll4, avg({c}_mean) OVER p8 AS {c}_mean_roll8, "
                 f"max({c}_mean) OVER p8 AS {c}_max_roll8" for c in CHANNELS)
PREVFRAMES = ", ".join(f"p{w} AS (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
                       for w in (4, 8))
PREV_COLS = [f"{c}_{s}" for c in CHANNELS for s in ("mean_roll4", "max_roll4", "std_roll4", "mean_roll8", "max_roll8")]


@query("roll_prev", "region_id:s week_idx:i " + " ".join(PREV_COLS),
       f"SELECT region_id, week_idx, {PREV} FROM wk WINDOW {PREVFRAMES}")
def roll_prev(spark, d):
    return ro.weekly_frames(weekly(spark, d), ro.previous_weeks(), 8)


SUMS = [(c, w, k) for c in ("prec_sum", "tmp_mean") for w, k in ((4, 2), (12, 4), (26, 4), (52, 4))]


@query("roll_sum_min", "region_id:s week_idx:i " + " ".join(f"{c}_sum{w}" for c, w, _ in SUMS),
       "SELECT region_id, week_idx, " + ", ".join(
           f"CASE WHEN count({c}) OVER w{w} >= {max(k, w // 2)} THEN sum({c}) OVER w{w} END AS {c}_sum{w}" for c, w, k in SUMS)
       + f" FROM wk WINDOW {WEEKFRAMES}")
def roll_sum_min(spark, d):
    return ro.weekly_frames(weekly(spark, d), {f"{c}_sum{w}": ro.rolling_sum(c, w, k) for c, w, k in SUMS}, 51)


from panelcast.config import TREND_COLUMNS  # noqa: E402


def slope_sql(c, n):
    mid, var = (n - 1) / 2, sum((i - (n - 1) / 2) ** 2 for i in range(n))
    return "(" + " + ".join(f"coalesce(lag({c},{k},0) OVER o, 0)*({n - k - mid})" for k in range(1, n + 1)) + f")/{var}"


@query("lag_slope", "region_id:s week_idx:i " + " ".join(f"slope{n}_{c}" for n in (4, 8) for c in TREND_COLUMNS),
       "SELECT region_id, week_idx, " + ", ".join(f"{slope_sql(c, n)} AS slope{n}_{c}" for n in (4, 8) for c in TREND_COLUMNS)
       + " FROM wk WINDOW o AS (PARTITION BY region_id ORDER BY week_idx)")
def lag_slope(spark, d):
    w = weekly(spark, d).na.fill(0.0, TREND_COLUMNS)
    return ro.weekly_frames(w, {f"slope{n}_{c}": ro.lag_slope(c, n) for n in (4, 8) for c in TREND_COLUMNS}, 8)


KERNELS = (13, 25, 101)
DEC = ["prec_sum", "surf_pre_sum"]
DEC_WINDOWS = ("a AS (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), " + ", ".join(
    f"b{k} AS (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN {(k - 1) // 2} PRECEDING AND {k // 2} FOLLOWING), "
    f"f{k} AS (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN {(k - 1) // 2} PRECEDING AND 1 PRECEDING), "
    f"e{k} AS (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN 1 FOLLOWING AND {k // 2} FOLLOWING)" for k in KERNELS))


def decomp_sql(c, k):
    f, e = (k - 1) // 2, k // 2
    total = (f"(sum({c}) OVER b{k} + ({f} - count(*) OVER f{k})*first_value({c}) OVER a"
             f" + ({e} - count(*) OVER e{k})*last_value({c}) OVER a)/{k}")
    return f"{total} AS {c}_trend{k}, {c} - {total} AS {c}_season{k}"


def decomp_cols(cols, kind=""):
    return "region_id:s week_idx:i " + " ".join(f"{c}_{p}{k}{kind}" for c in cols for k in KERNELS for p in ("trend", "season"))


WINDOW_WEEKS = 260


def all_kernels(df, cols):
    for k in KERNELS:
        df = ro.decompose(df, cols, k).withColumnsRenamed({f"{c}_{p}": f"{c}_{p}{k}" for c in cols for p in ("trend", "season")})
    return df


@query("seq_decomp", decomp_cols(CH15, ":r"), "SELECT region_id, week_idx, " + ", ".join(decomp_sql(c, k) for c in CH15 for k in KERNELS)
       + f" FROM ({CH15_SQL}) WINDOW {DEC_WINDOWS}")
def seq_decomp(spark, d):
    """All fifteen weekly channels with the three kernels."""
    return all_kernels(wk.weekly_channels(imputed(spark, d)), CH15)


@query("seq_decomp_sums", decomp_cols(DEC), "SELECT region_id, week_idx, " + ", ".join(decomp_sql(c, k) for c in DEC for k in KERNELS)
       + f" FROM wk WINDOW {DEC_WINDOWS}")
def seq_decomp_sums(spark, d):
    return all_kernels(weekly(spark, d), DEC)


@query("seq_window", "region_id:s pos:i n_anchors:i n_padded:i " + " ".join(f"{c}:r" for c in CH15), f"""
SELECT a.region_id, a.pos, count(*) n_anchors, count(*) FILTER (place < 0) n_padded,
  {", ".join(f"avg(coalesce(w.{c}, 0)) AS {c}" for c in CH15)}
FROM (SELECT *, week_idx - {WINDOW_WEEKS - 1} + pos AS place FROM (
  SELECT region_id, week_idx, unnest(range(0, {WINDOW_WEEKS})) pos FROM ch)) a
JOIN ch w ON w.region_id = a.region_id AND w.week_idx = greatest(0, place) GROUP BY 1, 2""",
       prefix=f"{PREFIX}, ch AS ({CH15_SQL})")
def seq_window(spark, d):
    """Windows of 260 weeks and fifteen channels of every week, as means per region and place in the window."""
    weeks = wk.weekly_channels(imputed(spark, d))
    return sq.place_means(weeks, weeks.select("region_id", "week_idx"), CH15, WINDOW_WEEKS)


SEQ_LEN = 26


@query("seq_window_rows", "region_id:s week_idx:i pos:i prec_sum tmp_mean", f"""
SELECT a.region_id, a.week_idx, p.pos, w.prec_sum, w.tmp_mean
FROM wk a CROSS JOIN (SELECT unnest(range(0, {SEQ_LEN})) pos) p
JOIN wk w ON w.region_id = a.region_id AND w.week_idx = greatest(0, a.week_idx - {SEQ_LEN - 1} + p.pos)""")
def seq_window_rows(spark, d):
    """Windows as arrays, one row per place, for short windows of few channels."""
    s = ro.sequence_window(weekly(spark, d), ["prec_sum", "tmp_mean"], SEQ_LEN)
    pairs = F.arrays_zip(F.col("prec_sum_seq").alias("a"), F.col("tmp_mean_seq").alias("b"))
    return s.select("region_id", "week_idx", F.posexplode(pairs).alias("pos", "v")).select(
        "region_id", "week_idx", "pos", F.col("v.a").alias("prec_sum"), F.col("v.b").alias("tmp_mean"))


@query("seq_decomp_window", "region_id:s week_idx:i last_trend first_trend last_season", """
SELECT a.region_id, a.week_idx, (sum(w.prec_sum*k_last))/13 last_trend, (sum(w.prec_sum*k_first))/13 first_trend,
  max(w.prec_sum) FILTER (p.pos = 25) - (sum(w.prec_sum*k_last))/13 last_season
FROM wk a CROSS JOIN (SELECT pos, CASE WHEN pos < 19 THEN 0 WHEN pos < 25 THEN 1 ELSE 7 END k_last,
    CASE WHEN pos = 0 THEN 7 WHEN pos <= 6 THEN 1 ELSE 0 END k_first FROM (SELECT unnest(range(0, 26)) pos)) p
JOIN wk w ON w.region_id = a.region_id AND w.week_idx = greatest(0, a.week_idx - 25 + p.pos) GROUP BY 1, 2""")
def seq_decomp_window(spark, d):
    """Decomposition inside each anchor's padded 26-week window, kernel 13."""
    s = ro.sequence_window(weekly(spark, d), ["prec_sum"], 26)
    trend, season = ro.sequence_decomposition(F.col("prec_sum_seq"), 13)
    s = s.withColumns({"t": trend, "s": season})
    return s.select("region_id", "week_idx", F.element_at("t", -1).alias("last_trend"),
                    F.element_at("t", 1).alias("first_trend"), F.element_at("s", -1).alias("last_season"))


@query("overlap_calc", "region_id:s week_idx:i step:i overlap", """
SELECT region_id, week_idx, step, greatest(0, 91 - step*7)/91 AS overlap
FROM wk CROSS JOIN (SELECT unnest(range(1, 16)) step)""")
def overlap_calc(spark, d):
    return ro.window_overlap(weekly(spark, d).select("region_id", "week_idx"))
