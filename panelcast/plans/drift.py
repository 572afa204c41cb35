"""Descriptive analysis and drift."""
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, HORIZONS
from panelcast.operators import drift as dr, gaps, indices as ix, lags as lg
from panelcast.plans.base import query
from panelcast.plans.inputs import anchors, gapped_train, stored_train, test, train, weekly
from panelcast.operators.weekly import weekly_blocks
from panelcast.sources.files import scored_rows, store
from panelcast.sources.panel import table

PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1:]]
SCORED = "train WHERE score IS NOT NULL"


def scored(spark, d):
    return scored_rows(train(spark, d))


def scored_weeks(spark, d):
    """Scored days with their own daily values and a week number."""
    return scored(spark, d).withColumn("week_idx", F.floor(F.col("day_idx") / 7))


def shifted_gaps(spark, d):
    return gaps.gap_weeks(gapped_train(spark, d), test(spark, d))


COLS = [*CHANNELS, "score"]


@query("eda_missing", "column_name:s n_missing:i missing_pct", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, 100*(count(*) - count({c}))/count(*) AS missing_pct FROM train" for c in COLS))
def eda_missing(spark, d):
    return dr.missing(train(spark, d), COLS)


@query("eda_uniform", "min_rows:i max_rows:i n_sizes:i n_regions:i", """
SELECT min(n) min_rows, max(n) max_rows, count(DISTINCT n) n_sizes, count(*) n_regions FROM (SELECT region_id, count(*) n FROM gtrain GROUP BY 1)""")
def eda_uniform(spark, d):
    return dr.uniformity(gapped_train(spark, d))


@query("eda_events", "event_type:s n:i users:i value_mean", """
SELECT event_type, count(*) n, count(DISTINCT user_id) users, avg(value) value_mean FROM events GROUP BY 1""")
def eda_events(spark, d):
    """Value counts of a second source: users are counted in two steps, so no set of them is kept."""
    e = table(spark, d, "events")
    per_user = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"), F.count("value").alias("k"))
    return per_user.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"),
                                              (F.sum("v") / F.sum("k")).alias("value_mean"))


@query("eda_score_dist", "score:i n:i pct cum_pct", f"""
SELECT score, n, 100*n/sum(n) OVER () pct, 100*sum(n) OVER (ORDER BY score)/sum(n) OVER () cum_pct
FROM (SELECT score, count(*) n FROM {SCORED} GROUP BY 1)""")
def eda_score_dist(spark, d):
    return dr.score_distribution(scored(spark, d))


@query("eda_score_summary", "zero_rate mean_nonzero severe_share", f"""
SELECT avg(CAST(score = 0 AS INT)) zero_rate, avg(score) FILTER (score > 0) mean_nonzero, avg(CAST(score >= 3 AS INT)) severe_share FROM {SCORED}""")
def eda_score_summary(spark, d):
    return dr.score_summary(scored(spark, d))


@query("eda_region_hist", "bin:i n_regions:i mean mean_std max_score:i", f"""
SELECT bin, count(*) n_regions, avg(m) AS mean, avg(s) mean_std, max(x) max_score FROM (
  SELECT *, CASE WHEN max(m) OVER () > min(m) OVER () THEN least(39, floor((m - min(m) OVER ())*40/(max(m) OVER () - min(m) OVER ()))) ELSE 0 END AS bin
  FROM (SELECT region_id, avg(score) m, stddev_samp(score) s, max(score) x FROM {SCORED} GROUP BY 1)) GROUP BY 1""")
def eda_region_hist(spark, d):
    return dr.region_histogram(scored(spark, d))


ACF = """SELECT w.region_id, k AS lag, sum((w.score - m)*(z.score - m))/any_value(v) AS acf
FROM wk w JOIN (SELECT region_id, avg(score) m, var_pop(score)*count(*) v FROM wk GROUP BY 1 HAVING v > 0) USING (region_id)
CROSS JOIN (SELECT unnest(range(0, 41)) k) JOIN wk z ON z.region_id = w.region_id AND z.week_idx = w.week_idx + k GROUP BY 1, 2"""


@query("eda_acf", "region_id:s lag:i acf", ACF)
def eda_acf(spark, d):
    a = dr.autocorrelation(weekly(spark, d))
    return a.select("region_id", F.posexplode("acf").alias("lag", "acf"))


@query("eda_acf_first_low", "region_id:s first_low:i", f"""
SELECT region_id, min(lag) FILTER (acf < 0.05) AS first_low FROM ({ACF}) GROUP BY 1""")
def eda_acf_first_low(spark, d):
    a = dr.autocorrelation(weekly(spark, d))
    return a.withColumn("first_low", dr.first_low_lag(F.col("acf")))


@query("eda_acf_fw", "lag:i mean_acf", " UNION ALL ".join(
    f"SELECT {k} AS lag, avg(c) FILTER (NOT isnan(c)) AS mean_acf FROM (SELECT region_id, corr(score, s) c FROM (SELECT region_id, score, lead(score, {k}) OVER (PARTITION BY region_id ORDER BY week_idx) s FROM wk) GROUP BY 1)"
    for k in HORIZONS))
def eda_acf_fw(spark, d):
    return dr.mean_persistence(weekly(spark, d))


# Durbin-Levinson: phi holds the coefficients of order k, the last of them is the partial value.
PACF = f"""WITH RECURSIVE acf AS (SELECT region_id, list(acf ORDER BY lag) AS r FROM ({ACF}) GROUP BY 1),
steps AS (
  SELECT region_id, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS pacf FROM acf
  UNION ALL
  SELECT region_id, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - new*phi[k + 1 - i]), new), new FROM (
    SELECT *, CASE WHEN abs(below) > 1e-12 THEN above/below ELSE 0 END AS new FROM (
      SELECT *, 1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i]*r[i + 1])), 0) AS below,
        r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i]*r[k + 2 - i])), 0) AS above
      FROM steps WHERE k + 1 < len(r))))
SELECT region_id, k AS lag, pacf FROM steps"""


@query("eda_pacf", "region_id:s lag:i pacf", PACF)
def eda_pacf(spark, d):
    a = dr.autocorrelation(weekly(spark, d)).withColumn("p", dr.partial_autocorrelation("acf"))
    return a.select("region_id", F.posexplode("p").alias("lag", "pacf"))


CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM {{src}}" for a, b in PAIRS)


@query("eda_corr", "a:s b:s corr", CORR_SQL.format(src="train"))
def eda_corr(spark, d):
    return dr.correlations(train(spark, d), CHANNELS)


@query("eda_corr_top", "a:s b:s corr", f"SELECT * FROM ({CORR_SQL.format(src='train')}) ORDER BY abs(corr) DESC LIMIT 5")
def eda_corr_top(spark, d):
    """The five most collinear pairs, a report."""
    return dr.top_pairs(dr.correlations(train(spark, d), CHANNELS), 5)


@query("eda_corr_score", "feature:s target:s corr", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'score' AS target, corr({c}, score) AS corr FROM {SCORED}" for c in CHANNELS))
def eda_corr_score(spark, d):
    return dr.feature_target_correlations(scored(spark, d), CHANNELS, ["score"])


@query("eda_spearman", "channel:s spearman n:i", " UNION ALL ".join(
    f"""SELECT '{c}' AS channel, corr(rx, ry) AS spearman, count(*) n FROM (SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2 rx,
    rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2 ry FROM train WHERE score IS NOT NULL AND {c} IS NOT NULL)""" for c in CHANNELS))
def eda_spearman(spark, d):
    return dr.rank_correlation(scored(spark, d), CHANNELS)


MONTHS = f"SELECT month, avg(score) AS mean, stddev_samp(score) AS std, count(*) n, stddev_samp(score)/sqrt(count(*)) se FROM {SCORED} GROUP BY 1"


@query("eda_monthly", "month:i mean std n:i se", MONTHS)
def eda_monthly(spark, d):
    return dr.monthly_scores(scored(spark, d))


@query("eda_monthly_range", "peak_month:i trough_month:i amplitude",
       f"SELECT max_by(month, mean) peak_month, min_by(month, mean) trough_month, max(mean) - min(mean) amplitude FROM ({MONTHS})")
def eda_monthly_range(spark, d):
    return dr.seasonal_range(dr.monthly_scores(scored(spark, d)))


SEASON = "CASE WHEN month IN (12,1,2) THEN 'DJF' WHEN month < 6 THEN 'MAM' WHEN month < 9 THEN 'JJA' ELSE 'SON' END"


@query("eda_woy_season", "grp:s mean n:i", f"""
SELECT 'woy' || woy1 AS grp, avg(score) AS mean, count(*) n FROM {SCORED} GROUP BY 1 UNION ALL
SELECT {SEASON}, avg(score), count(*) FROM {SCORED} GROUP BY 1""")
def eda_woy_season(spark, d):
    from panelcast.functions.calendar import season
    s = scored(spark, d)
    both = F.explode(F.array(F.concat(F.lit("woy"), F.col("woy1").cast("string")), season(F.col("month"))))
    return s.select("score", both.alias("grp")).groupBy("grp").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


@query("eda_month_heat", "month:i " + " ".join(f"share_{s}" for s in range(6)), "SELECT month, " + ", ".join(
    f"avg(CAST(score = {s} AS INT)) share_{s}" for s in range(6)) + f" FROM {SCORED} GROUP BY 1")
def eda_month_heat(spark, d):
    return dr.month_heat(scored(spark, d))


@query("eda_outliers", "channel:s p1 p99 min max n_below:i n_above:i pct_below pct_above n_null:i", " UNION ALL ".join(f"""
SELECT '{c}' AS channel, p1, p99, min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} < p1) n_below, count(*) FILTER ({c} > p99) n_above,
  100*count(*) FILTER ({c} < p1)/count({c}) pct_below, 100*count(*) FILTER ({c} > p99)/count({c}) pct_above, count(*) - count({c}) n_null
FROM train CROSS JOIN (SELECT quantile_cont({c}, 0.01) p1, quantile_cont({c}, 0.99) p99 FROM train) GROUP BY p1, p99""" for c in CHANNELS))
def eda_outliers(spark, d):
    return dr.outliers(stored_train(spark, d), CHANNELS)


@query("eda_extremes", "channel:s side:s rank:i region_id:s day_idx:i value", " UNION ALL ".join(f"""
SELECT '{c}' AS channel, '{side}' AS side, row_number() OVER (ORDER BY {c} {o}, region_id, day_idx) AS rank, region_id, day_idx, {c} AS value
FROM train WHERE {c} IS NOT NULL QUALIFY rank <= {k}""" for c in CHANNELS for side, o, k in (("above", "DESC", 3), ("below", "ASC", 2))))
def eda_extremes(spark, d):
    """Top-k rows per channel, a report."""
    return dr.extremes(stored_train(spark, d), CHANNELS)


@query("eda_shape", "channel:s n:i skew kurt_excess recommended:s", " UNION ALL ".join(f"""
SELECT '{c}' AS channel, n, skew, kurt_excess, CASE WHEN abs(skew) > 2 AND lo >= 0 THEN 'log1p' WHEN abs(skew) > 2 THEN 'signed_log1p'
  WHEN abs(skew) > 1 THEN 'sqrt' ELSE 'none' END AS recommended FROM (SELECT count({c}) n, skewness({c}) skew, kurtosis({c}) kurt_excess, min({c}) lo FROM train)""" for c in CHANNELS))
def eda_shape(spark, d):
    return dr.distribution_shape(train(spark, d), CHANNELS)


def ks_sql(c):
    return f"""SELECT '{c}' AS channel, (SELECT max(abs(fa - fb)) FROM (SELECT sum(a) OVER o/sum(a) OVER () fa, sum(b) OVER o/sum(b) OVER () fb FROM (
    SELECT v, sum(a) a, sum(b) b FROM (SELECT {c} v, 1 a, 0 b FROM train UNION ALL SELECT {c}, 0, 1 FROM test) WHERE v IS NOT NULL GROUP BY 1) WINDOW o AS (ORDER BY v))) AS ks,
  (SELECT avg({c}) FROM test) - (SELECT avg({c}) FROM train) AS mean_delta, (SELECT quantile_cont({c}, 0.5) FROM train) AS train_median,
  (SELECT quantile_cont({c}, 0.5) FROM test) AS test_median, ks > 0.1 AS alert"""


@query("eda_ks", "channel:s ks mean_delta train_median test_median alert:b",
       "SELECT channel, ks, mean_delta, train_median, test_median, ks > 0.1 AS alert FROM (" + " UNION ALL ".join(
           ks_sql(c).replace(", ks > 0.1 AS alert", "") for c in CHANNELS) + ")")
def eda_ks(spark, d):
    return dr.ks_distance(stored_train(spark, d), store(test(spark, d), "test"), CHANNELS)


@query("eda_offset", "channel:s offset_", " UNION ALL ".join(
    f"SELECT '{c}' AS channel, (SELECT quantile_cont({c}, 0.5) FROM test) - (SELECT quantile_cont({c}, 0.5) FROM train) AS offset_" for c in CHANNELS))
def eda_offset(spark, d):
    return dr.median_offsets(stored_train(spark, d), test(spark, d), CHANNELS).withColumnRenamed("offset", "offset_")


@query("eda_offset_top", "channel:s offset_", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, (SELECT quantile_cont({c}, 0.5) FROM test) - (SELECT quantile_cont({c}, 0.5) FROM train) AS offset_" for c in CHANNELS)
       + ") ORDER BY abs(offset_) DESC LIMIT 3")
def eda_offset_top(spark, d):
    """The three largest offsets, a report."""
    return eda_offset(spark, d).orderBy(F.desc(F.abs("offset_"))).limit(3)


TRANS = " UNION ALL ".join(f"""SELECT {k} AS lag, score AS from_, s AS to_, count(*) n, count(*)/sum(count(*)) OVER (PARTITION BY score) p FROM (
  SELECT score, lead(score, {k}) OVER (PARTITION BY region_id ORDER BY week_idx) s FROM wk) WHERE s IS NOT NULL GROUP BY score, s""" for k in HORIZONS)


def cells(spark, d):
    return dr.transitions(weekly(spark, d))


@query("eda_transition", "lag:i from_:i to_:i n:i p", TRANS)
def eda_transition(spark, d):
    return cells(spark, d).withColumnsRenamed({"from": "from_", "to": "to_"})


@query("eda_persistence", "lag:i zero_zero severe_severe severe_from5", f"""
SELECT lag, max(z) FILTER (from_ = 0) zero_zero, sum(s) FILTER (from_ >= 3)/3 severe_severe, max(s) FILTER (from_ = 5) severe_from5 FROM (
  SELECT lag, from_, coalesce(sum(p) FILTER (to_ = 0), 0) z, coalesce(sum(p) FILTER (to_ >= 3), 0) s FROM ({TRANS}) GROUP BY 1, 2) GROUP BY 1""")
def eda_persistence(spark, d):
    return dr.persistence(cells(spark, d))


LAGCORR = " UNION ALL ".join(f"""SELECT '{c}' AS channel, {k} AS lag, avg(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END) AS corr FROM (SELECT region_id, corr(x, score) r FROM (
  SELECT region_id, score, lag({c}, {k}) OVER (PARTITION BY region_id ORDER BY day_idx) x FROM {SCORED}) GROUP BY 1 HAVING stddev_pop(score) >= 1e-6)""" for c in CHANNELS for k in range(13))


@query("eda_lagcorr", "channel:s lag:i corr", LAGCORR)
def eda_lagcorr(spark, d):
    return dr.lag_correlations(scored_weeks(spark, d), CHANNELS)


@query("eda_lagcorr_best", "channel:s best_lag:i best_corr",
       f"SELECT channel, arg_max(lag, abs(corr)) best_lag, arg_max(corr, abs(corr)) best_corr FROM ({LAGCORR}) GROUP BY 1")
def eda_lagcorr_best(spark, d):
    return dr.best_lag(dr.lag_correlations(scored_weeks(spark, d), CHANNELS))


@query("eda_lagcorr_prec", "lag:i corr", " UNION ALL ".join(f"""SELECT {k} AS lag, avg(r) FILTER (NOT isnan(r)) AS corr FROM (SELECT region_id, corr(x, score) r FROM (
  SELECT region_id, score, lead(prec, {k}) OVER (PARTITION BY region_id ORDER BY day_idx) x FROM {SCORED}) GROUP BY 1)""" for k in (1, 2, 4, 8, 13)))
def eda_lagcorr_prec(spark, d):
    return dr.reversed_lag_correlations(scored_weeks(spark, d))


INDICATORS = {"vpd": "tmp - wb_tmp", "dry_day": "CAST(coalesce(prec < 0.1, false) AS INT)", "dtr": "tmp_max - tmp_min",
              "prec": "prec", "humidity": "humidity"}


@query("eda_by_score", "score:i " + " ".join(f"{i}_mean {i}_sem" for i in INDICATORS), "SELECT score, " + ", ".join(
    f"avg({e}) {i}_mean, stddev_samp({e})/sqrt(count({e})) {i}_sem" for i, e in INDICATORS.items()) + f" FROM {SCORED} GROUP BY 1")
def eda_by_score(spark, d):
    df = ix.daily_signals(train(spark, d)).withColumn("dtr", F.col("tmp_max") - F.col("tmp_min"))
    return dr.by_score(df, list(INDICATORS))


@query("eda_gap_stats", "mean std min max p25 median p75 p90 iqr acf_at_mean acf_at_median", """
SELECT *, p75 - p25 iqr, pow(0.96, mean) acf_at_mean, pow(0.96, median) acf_at_median FROM (SELECT avg(gap_weeks) AS mean, stddev_pop(gap_weeks) AS std, min(gap_weeks) AS min, max(gap_weeks) AS max,
  quantile_cont(gap_weeks, 0.25) p25, quantile_cont(gap_weeks, 0.5) AS median, quantile_cont(gap_weeks, 0.75) p75, quantile_cont(gap_weeks, 0.9) p90 FROM gap)""")
def eda_gap_stats(spark, d):
    return dr.gap_statistics(shifted_gaps(spark, d))


@query("eda_gap_trend", "slope r", """
SELECT regr_slope(m, gap_weeks) slope, corr(gap_weeks, m) r FROM gap JOIN (SELECT region_id, avg(score) m FROM train GROUP BY 1) USING (region_id)""")
def eda_gap_trend(spark, d):
    return dr.gap_trend(shifted_gaps(spark, d), scored(spark, d))


BUCKET = """SELECT region_id, gap_weeks, CASE WHEN gap_weeks < 20 THEN '0-20w' WHEN gap_weeks < 40 THEN '20-40w'
  WHEN gap_weeks < 60 THEN '40-60w' WHEN gap_weeks < 80 THEN '60-80w' ELSE '80w+' END AS bucket FROM gap"""
SIM = "CASE bucket WHEN '0-20w' THEN 10 WHEN '20-40w' THEN 30 WHEN '40-60w' THEN 50 WHEN '60-80w' THEN 70 ELSE 85 END"


@query("eda_lag_validity", "bucket:s lag:i horizon:i mean_corr n_regions:i", f"""
SELECT bucket, lag, horizon, avg(r) FILTER (NOT isnan(r)) mean_corr, count(*) n_regions FROM (
  SELECT b.region_id, bucket, {SIM} AS lag, horizon, corr(x.score, y.score) r FROM ({BUCKET}) b CROSS JOIN (SELECT unnest([1,2,3,4,5]) horizon)
  JOIN wk x ON x.region_id = b.region_id JOIN wk y ON y.region_id = b.region_id AND y.week_idx = x.week_idx + {SIM} + horizon - 1 GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2, 3""")
def eda_lag_validity(spark, d):
    b = shifted_gaps(spark, d).select("region_id", gaps.gap_bucket(F.col("gap_weeks")).alias("bucket"))
    return dr.lag_validity(weekly(spark, d), b)


@query("eda_prior_vs_lag", "scope:s n:i mae_lag mae_prior r2_lag r2_prior best_alpha best_mae", """
WITH g AS (SELECT region_id, gap_weeks, greatest(4, CAST(round(gap_weeks) AS BIGINT)) AS g FROM gap),
r AS (SELECT w.region_id, gap_weeks, w.score, z.score AS lagged, CASE WHEN count(*) OVER m >= 3 THEN mm ELSE rm END AS prior FROM
  (SELECT *, avg(score) OVER (PARTITION BY region_id, month) mm, avg(score) OVER (PARTITION BY region_id) rm FROM wk) w
  JOIN g USING (region_id) JOIN wk z ON z.region_id = w.region_id AND z.week_idx = w.week_idx - g.g WINDOW m AS (PARTITION BY w.region_id, w.month)),
s AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT 'long', * FROM r WHERE gap_weeks >= 40),
x AS (SELECT scope, a/20 AS alpha, avg(abs(a/20*lagged + (1 - a/20)*prior - score)) e FROM s CROSS JOIN (SELECT unnest(range(0, 21)) a) GROUP BY 1, 2)
SELECT * FROM (SELECT scope, count(*) n, avg(abs(lagged - score)) mae_lag, avg(abs(prior - score)) mae_prior, 1 - avg(pow(lagged - score, 2))/var_pop(score) r2_lag,
  1 - avg(pow(prior - score, 2))/var_pop(score) r2_prior FROM s GROUP BY 1)
JOIN (SELECT scope, arg_min(alpha, e) best_alpha, min(e) best_mae FROM x GROUP BY 1) USING (scope)""")
def eda_prior_vs_lag(spark, d):
    return dr.prior_versus_lag(weekly(spark, d), shifted_gaps(spark, d))


FT = ["score_lag1", "score_lag4", "weeks_since_last_nonzero", "max_score_prev8", "prec_sum", "tmp_max_mean"]


@query("eda_feature_target", "feature:s target:s corr", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, 'target_w{h}' AS target, corr({f}, target_w{h}) AS corr FROM h" for f in FT for h in HORIZONS).join([
        """WITH h AS (SELECT anc.*, score_lag1, score_lag4, weeks_since_last_nonzero, max_score_prev8 FROM anc JOIN (
  SELECT region_id, week_idx, lag(score, 13, 0) OVER o score_lag1, lag(score, 16, 0) OVER o score_lag4,
    coalesce(week_idx - 12 - max(CASE WHEN score > 0 THEN week_idx END) OVER (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN 38 PRECEDING AND 13 PRECEDING), 26) weeks_since_last_nonzero,
    coalesce(max(score) OVER (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN 20 PRECEDING AND 13 PRECEDING), 0) max_score_prev8
  FROM wk WINDOW o AS (PARTITION BY region_id ORDER BY week_idx)) USING (region_id, week_idx)) """, ""]))
def eda_feature_target(spark, d):
    df = lg.lead_targets(lg.with_score_history(weekly(spark, d)))
    return dr.feature_target_correlations(df, FT, [f"target_w{h}" for h in HORIZONS])


@query("eda_summary", "section:s metric:s key:s value")
def eda_summary(spark, d):
    t = stored_train(spark, d)
    s, w = scored_rows(t), weekly_blocks(t, keep=["score"])
    return dr.findings({
        "missing": (dr.missing(t, COLS), ["column_name"]), "uniform": (dr.uniformity(t), []),
        "score": (dr.score_distribution(s), ["score"]), "score_summary": (dr.score_summary(s), []),
        "monthly": (dr.monthly_scores(s), ["month"]), "shape": (dr.distribution_shape(t, CHANNELS), ["channel"]),
        "drift": (dr.median_offsets(t, test(spark, d), CHANNELS), ["channel"]),
        "transition": (dr.transitions(w), ["lag", "from", "to"]), "corr": (dr.correlations(t, CHANNELS), ["a", "b"])})
