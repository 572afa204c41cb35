"""Descriptive statistics, dependence and train/test drift.

Global orders are never taken over raw rows: values are counted first and ranked through
functions/ranks.py, and per-region statistics are aggregates of chunked windows.
"""
from pyspark.sql import Window, functions as F

from panelcast.config import CHANNELS, HORIZONS, KEY, WEEK, WEEK_CHUNK
from panelcast.functions import ranks
from panelcast.functions.chunks import chunked, over, owned
from panelcast.functions.scalars import corr, corr_sql
from panelcast.operators.asof import DECAY
from panelcast.operators.cleaning import attach


def missing(df, cols):
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    long = one.unpivot(["_n"], list(cols), "column_name", "present")
    return long.select("column_name", (F.col("_n") - F.col("present")).alias("n_missing"),
                       (100 * (F.col("_n") - F.col("present")) / F.col("_n")).alias("missing_pct")).orderBy(F.desc("missing_pct"))


def uniformity(df):
    sizes = df.groupBy(KEY).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("min_rows"), F.max("n").alias("max_rows"),
                     F.countDistinct("n").alias("n_sizes"), F.count("*").alias("n_regions"))


def score_distribution(scored):
    """Counts, shares and cumulative shares of the six scores."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return counts.withColumns({"pct": 100 * F.col("n") / F.sum("n").over(whole),
                               "cum_pct": 100 * F.sum("n").over(whole.orderBy("score")) / F.sum("n").over(whole)})


def score_summary(scored):
    s = F.col("score")
    return scored.agg(F.avg((s == 0).cast("double")).alias("zero_rate"), F.avg(F.when(s > 0, s)).alias("mean_nonzero"),
                      F.avg((s >= 3).cast("double")).alias("severe_share"))


def region_histogram(scored, bins=40):
    """Histogram of the region means over equal-width bins between their extremes."""
    means = scored.groupBy(KEY).agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s"), F.max("score").alias("x"))
    df = attach(means, means.agg(F.min("m").alias("lo"), F.max("m").alias("hi")), "_r")
    at = F.floor((F.col("m") - F.col("_r.lo")) * bins / (F.col("_r.hi") - F.col("_r.lo")))
    df = df.withColumn("bin", F.when(F.col("_r.hi") > F.col("_r.lo"), F.least(F.lit(bins - 1), at)).otherwise(0))
    return df.groupBy("bin").agg(F.count("*").alias("n_regions"), F.avg("m").alias("mean"),
                                 F.avg("s").alias("mean_std"), F.max("x").alias("max_score"))


def autocorrelation(weekly, lags=40):
    """Autocorrelation of the weekly score per region, lags 0 .. lags, in one array.

    Products at all lags come from one window; no pairs of rows are built.
    """
    mean = weekly.groupBy(KEY).agg(F.avg("score").alias("_m"))
    cut = chunked(weekly.select(KEY, WEEK, "score").join(mean, KEY).withColumn("_d", F.col("score") - F.col("_m")),
                  WEEK, WEEK_CHUNK, after=lags)
    w = over(KEY, WEEK)
    cut = owned(cut.selectExpr("*", *[f"_d * lead(_d, {k}) {w} AS _p{k}" for k in range(1, lags + 1)]))
    sums = cut.groupBy(KEY).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"),
                                *[F.expr(f"sum(_p{k}) AS _p{k}") for k in range(1, lags + 1)])
    values = ", ".join(["1D"] + [f"coalesce(_p{k}, 0D) / _v" for k in range(1, lags + 1)])
    return sums.filter("_v > 0").selectExpr(KEY, f"array({values}) AS acf")


def first_low_lag(acf, limit=0.05):
    """First lag whose autocorrelation is below the limit."""
    low = F.filter(F.sequence(F.lit(0), F.size(acf) - 1), lambda i: F.get(acf, i) < limit)
    return F.get(low, F.lit(0))


def partial_autocorrelation(acf):
    """Durbin-Levinson recursion on an array column of autocorrelations, lag 0 first.

    The state is the coefficients of the order so far and the partial values; an order without variance left gives 0.
    """
    acf = F.col(acf) if isinstance(acf, str) else acf
    none = F.array().cast("array<double>")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state, k):
        phi, known = state["phi"], F.slice(acf, F.lit(2), k - 1)
        below = 1.0 - dot(phi, known)
        above = F.get(acf, k) - dot(phi, F.reverse(known))
        # the new value is used for every coefficient, so it is computed once, as the only element of an array
        new = F.array(F.when(F.abs(below) > 1e-12, above / below).otherwise(0.0))
        both = F.zip_with(phi, F.reverse(phi), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return F.get(F.transform(new, lambda n: F.struct(
            F.concat(F.transform(both, lambda p: p["x"] - n * p["y"]), F.array(n)).alias("phi"),
            F.concat(state["out"], F.array(n)).alias("out"))), F.lit(0))

    orders = F.filter(F.sequence(F.lit(1), F.greatest(F.size(acf) - 1, F.lit(1))), lambda k: k < F.size(acf))
    start = F.struct(none.alias("phi"), F.array(F.lit(1.0)).alias("out"))
    return F.when(acf.isNotNull(), F.aggregate(orders, start, step, lambda s: s["out"]))


def mean_persistence(weekly, lags=HORIZONS):
    """Mean over regions of corr(score, score k weeks later)."""
    w = over(KEY, WEEK)
    cut = owned(chunked(weekly.select(KEY, WEEK, "score"), WEEK, WEEK_CHUNK, after=max(lags)).selectExpr(
        "*", *[f"lead(score, {k}) {w} AS s{k}" for k in lags]))
    per = cut.groupBy(KEY).agg(*[corr("score", f"s{k}").alias(f"c{k}") for k in lags])
    one = per.agg(*[F.avg(f"c{k}").alias(f"c{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("mean_acf")) for k in lags])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def correlations(df, cols):
    """All pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    both = F.split("pair", "\\|")
    return long.select(both[0].alias("a"), both[1].alias("b"), "corr")


def top_pairs(pairs, k):
    return pairs.orderBy(F.desc(F.abs("corr")), "a", "b").limit(k)


def rank_correlation(df, cols, target="score"):
    """Spearman correlation of every column with the target.

    Distinct (value, target) pairs are counted, both sides get tie-averaged ranks from
    running counts over value buckets, so a continuous target is ranked by as many tasks as
    a column, and the correlation is a weighted sum over the pairs. Rows without a target are
    left out, per channel also those without a value; a side of one value has no correlation.
    """
    df = df.filter(F.col(target).isNotNull())
    borders = ranks.bucket_borders(df, [*cols, target])
    target_borders = borders.pop(target)
    long = df.select(F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["y"], list(cols), "channel", "v").dropna()
    pairs = long.groupBy("channel", "v", "y").agg(F.count("*").alias("w"))
    xs = ranks.average_ranks(pairs.groupBy("channel", "v").agg(F.sum("w").alias("n")), borders)
    ys = ranks.average_ranks(pairs.groupBy("channel", F.col("y").alias("v")).agg(F.sum("w").alias("n")),
                             {c: target_borders for c in cols})
    j = (pairs.join(xs.select("channel", "v", F.col("rank").alias("rx"), "n_all"), ["channel", "v"])
         .join(ys.select("channel", F.col("v").alias("y"), F.col("rank").alias("ry")), ["channel", "y"]))
    mid = (F.col("n_all") + 1) / 2
    dx, dy, w = F.col("rx") - mid, F.col("ry") - mid, F.col("w")
    return j.groupBy("channel").agg(F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))).alias("spearman"),
                                    F.sum("w").alias("n"))


def monthly_scores(scored):
    out = scored.groupBy("month").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("*").alias("n"))
    return out.withColumn("se", F.col("std") / F.sqrt("n"))


def seasonal_range(monthly):
    return monthly.agg(F.max_by("month", "mean").alias("peak_month"), F.min_by("month", "mean").alias("trough_month"),
                       (F.max("mean") - F.min("mean")).alias("amplitude"))


def month_heat(scored):
    """Share of every score within each month, one column per score."""
    counts = scored.groupBy("month").pivot("score", list(range(6))).count().na.fill(0)
    total = sum((F.col(str(s)) for s in range(1, 6)), F.col("0"))
    return counts.select("month", *[(F.col(str(s)) / total).alias(f"share_{s}") for s in range(6)])


def outliers(df, cols, lo=0.01, hi=0.99):
    from panelcast.operators.cleaning import one_row, winsor_bounds
    bounds = winsor_bounds(df, cols, lo, hi)
    j = attach(df, one_row(bounds, cols, ["lo", "hi"]), "_w")
    one = j.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__n"), F.count_if(F.col(c).isNull()).alias(f"{c}__null"), F.min(c).alias(f"{c}__min"),
        F.max(c).alias(f"{c}__max"), F.count_if(F.col(c) < F.col(f"_w.{c}_lo")).alias(f"{c}__below"),
        F.count_if(F.col(c) > F.col(f"_w.{c}_hi")).alias(f"{c}__above"))])
    rows = one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("channel"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
        F.col(f"{c}__below").alias("n_below"), F.col(f"{c}__above").alias("n_above"), F.col(f"{c}__n").alias("n"),
        F.col(f"{c}__null").alias("n_null")) for c in cols])).alias("r")).select("r.*")
    return rows.join(bounds.withColumnsRenamed({"lo": "p1", "hi": "p99"}), "channel").withColumns({
        "pct_below": 100 * F.col("n_below") / F.col("n"), "pct_above": 100 * F.col("n_above") / F.col("n")})


def extremes(df, cols, top=3, bottom=2):
    """Largest and smallest rows per channel; the rank limit also applies before the shuffle."""
    long = df.select(KEY, "day_idx", *cols).unpivot([KEY, "day_idx"], list(cols), "channel", "value").filter("value is not null")
    def side(order, k, name):
        w = Window.partitionBy("channel").orderBy(order, KEY, "day_idx")
        return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("side", F.lit(name))
    return side(F.desc("value"), top, "above").unionByName(side(F.asc("value"), bottom, "below"))


def distribution_shape(df, cols, threshold=2.0):
    """Bias-corrected skewness and excess kurtosis and the transform they suggest."""
    one = df.agg(*[e for c in cols for e in (F.count(c).cast("double").alias(f"{c}__n"), F.skewness(c).alias(f"{c}__g1"),
                                            F.kurtosis(c).alias(f"{c}__g2"), F.min(c).alias(f"{c}__min"))])
    rows = one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("channel"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__g1").alias("g1"), F.col(f"{c}__g2").alias("g2"),
        F.col(f"{c}__min").alias("min")) for c in cols])).alias("r")).select("r.*")
    n = F.col("n")
    rows = rows.withColumns({"skew": F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"),
                             "kurt_excess": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)})
    size = F.abs("skew")
    rule = (F.when((size > threshold) & (F.col("min") >= 0), "log1p").when(size > threshold, "signed_log1p")
            .when(size > threshold / 2, "sqrt").otherwise("none"))
    return rows.withColumn("recommended", rule).drop("g1", "g2")


def ks_distance(train, test, cols, alert=0.1):
    """Two-sample Kolmogorov-Smirnov distance, means and medians per channel, over all rows.

    Distinct values carry their counts in both parts; running counts of both give the two
    distribution functions.
    """
    both = train.select(*cols, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select(*cols, F.lit(0).alias("a"), F.lit(1).alias("b")))
    borders = ranks.bucket_borders(both, cols)
    counts = ranks.value_counts(both, cols, weights={"a": F.col("a"), "b": F.col("b")})
    runs = ranks.running_counts(counts, borders, measures=("a", "b"))
    gap = F.abs(F.col("a_upto") / F.col("a_all") - F.col("b_upto") / F.col("b_all"))
    out = runs.groupBy("channel").agg(
        F.max(gap).alias("ks"), (F.sum(F.col("a") * F.col("v")) / F.sum("a")).alias("train_mean"),
        (F.sum(F.col("b") * F.col("v")) / F.sum("b")).alias("test_mean"))
    medians = [ranks.exact_quantiles(x, cols, [0.5], borders=borders).select("channel", F.col("value").alias(n))
               for x, n in ((train, "train_median"), (test, "test_median"))]
    out = out.join(medians[0], "channel").join(medians[1], "channel")
    return out.withColumns({"mean_delta": F.col("test_mean") - F.col("train_mean"), "alert": F.col("ks") > alert})


def median_offsets(train, test, cols):
    borders = ranks.bucket_borders(train, cols)
    a, b = (ranks.exact_quantiles(x, cols, [0.5], borders=borders).select("channel", F.col("value").alias(n))
            for x, n in ((train, "a"), (test, "b")))
    return a.join(b, "channel").select("channel", (F.col("b") - F.col("a")).alias("offset"))


def transitions(weekly, lags=HORIZONS):
    """P(score k weeks later | score), from counted pairs."""
    w = over(KEY, WEEK)
    cut = owned(chunked(weekly.select(KEY, WEEK, "score"), WEEK, WEEK_CHUNK, after=max(lags)).selectExpr(
        "*", *[f"lead(score, {k}) {w} AS s{k}" for k in lags]))
    one = cut.groupBy("score", *[f"s{k}" for k in lags]).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("to")) for k in lags])
    cells = one.select("score", "n", F.explode(pairs).alias("p")).filter("p.to IS NOT NULL").groupBy(
        F.col("p.lag").alias("lag"), F.col("score").alias("from"), F.col("p.to").alias("to")).agg(F.sum("n").alias("n"))
    return cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lag", "from")))


def persistence(cells):
    """P(0 stays 0), mean P(severe stays severe) over the severe scores seen, P(severe | 5)."""
    stay = cells.groupBy("lag", "from").agg(F.sum(F.when(F.col("to") >= 3, F.col("p")).otherwise(0.0)).alias("severe"),
                                            F.sum(F.when(F.col("to") == 0, F.col("p")).otherwise(0.0)).alias("zero"))
    return stay.groupBy("lag").agg(
        F.max(F.when(F.col("from") == 0, F.col("zero"))).alias("zero_zero"),
        (F.sum(F.when(F.col("from") >= 3, F.col("severe"))) / 3).alias("severe_severe"),
        F.max(F.when(F.col("from") == 5, F.col("severe"))).alias("severe_from5"))


def lag_correlations(weekly, cols, max_lag=12):
    """Mean over regions of corr(x k weeks ago, score), and the strongest lag per column.

    Regions with a constant score or fewer than max_lag + 5 weeks are left out; a constant
    column counts as 0.
    """
    w = over(KEY, WEEK)
    cut = chunked(weekly.select(KEY, WEEK, "score", *cols), WEEK, WEEK_CHUNK, before=max_lag)
    cut = owned(cut.selectExpr("*", *[f"lag({c}, {k}) {w} AS {c}__{k}" for c in cols for k in range(1, max_lag + 1)],
                               *[f"{c} AS {c}__0" for c in cols]))
    names = [f"{c}__{k}" for c in cols for k in range(max_lag + 1)]
    per = cut.groupBy(KEY).agg(
        F.count("*").alias("_n"), F.stddev_pop("score").alias("_sd"),
        *[F.expr(f"coalesce({corr_sql(n, 'score')}, 0D) AS {n}") for n in names])
    one = per.filter((F.col("_n") >= max_lag + 5) & (F.col("_sd") >= 1e-6)).agg(*[F.expr(f"avg({n}) AS {n}") for n in names])
    long = one.unpivot([], names, "name", "corr")
    parts = F.split("name", "__")
    return long.select(parts[0].alias("channel"), parts[1].cast("int").alias("lag"), "corr")


def best_lag(table):
    order = F.struct(F.abs("corr"), -F.col("lag"))
    return table.groupBy("channel").agg(F.max_by("lag", order).alias("best_lag"), F.max_by("corr", order).alias("best_corr"))


def reversed_lag_correlations(weekly, col="prec", lags=(1, 2, 4, 8, 13)):
    """Mean over regions of corr(x k weeks later, score), the direction the report uses."""
    w = over(KEY, WEEK)
    cut = owned(chunked(weekly.select(KEY, WEEK, "score", col), WEEK, WEEK_CHUNK, after=max(lags)).selectExpr(
        "*", *[f"lead({col}, {k}) {w} AS x{k}" for k in lags]))
    per = cut.groupBy(KEY).agg(F.count("*").alias("_n"), *[corr(f"x{k}", "score").alias(f"c{k}") for k in lags])
    one = per.agg(*[F.avg(F.when(F.col("_n") > k + 5, F.col(f"c{k}"))).alias(f"c{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("corr")) for k in lags])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def by_score(daily, cols):
    """Mean and standard error of each indicator per score."""
    scored = daily.filter(F.col("score").isNotNull())
    return scored.groupBy("score").agg(*[F.avg(c).alias(f"{c}_mean") for c in cols],
                                       *[(F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_sem") for c in cols])


def gap_statistics(gaps):
    g = F.col("gap_weeks")
    q = ranks.spread(ranks.exact_quantiles(gaps, ["gap_weeks"], [0.25, 0.5, 0.75, 0.9]),
                     {n: ("gap_weeks", i) for i, n in enumerate(("p25", "median", "p75", "p90"))})
    one = gaps.agg(F.avg(g).alias("mean"), F.stddev_pop(g).alias("std"), F.min(g).alias("min"), F.max(g).alias("max"))
    out = attach(one, q, "_q").select("*", "_q.*").drop("_q")
    return out.withColumns({"iqr": F.col("p75") - F.col("p25"), "acf_at_mean": F.pow(F.lit(DECAY), F.col("mean")),
                            "acf_at_median": F.pow(F.lit(DECAY), F.col("median"))})


def gap_trend(gaps, scored):
    means = scored.groupBy(KEY).agg(F.avg("score").alias("m"))
    return gaps.join(means, KEY).agg(F.regr_slope("m", "gap_weeks").alias("slope"), corr("gap_weeks", "m").alias("r"))


# The lag simulated for each gap bucket, in weeks.
BUCKET_LAG = {"0-20w": 10, "20-40w": 30, "40-60w": 50, "60-80w": 70, "80w+": 85}


def lag_validity(weekly, buckets, horizons=HORIZONS):
    """Per gap bucket and horizon the mean over regions of corr(score, score lag + h - 1 weeks earlier).

    The earlier score is found by an equi-join on (region, week).
    """
    lag = F.lit(None).cast("int")
    for b, k in BUCKET_LAG.items():
        lag = F.when(F.col("bucket") == b, k).otherwise(lag)
    s = weekly.select(KEY, WEEK, "score")
    sizes = s.groupBy(KEY).agg(F.count("*").alias("_n"))
    src = (s.join(buckets.withColumn("lag", lag), KEY).join(sizes, KEY).filter(F.col("_n") >= F.col("lag") + 5)
           .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))))
    moved = src.select(KEY, "bucket", "horizon", "lag", (F.col(WEEK) + F.col("lag") + F.col("horizon") - 1).alias(WEEK),
                       F.col("score").alias("earlier"))
    per = moved.join(s, [KEY, WEEK]).groupBy(KEY, "bucket", "lag", "horizon").agg(
        corr("earlier", "score").alias("r"), F.count("*").alias("_k")).filter("_k > 5")
    return per.groupBy("bucket", "lag", "horizon").agg(F.avg("r").alias("mean_corr"),
                                                       F.count("*").alias("n_regions"))


def prior_versus_lag(weekly, gaps, long_gap=40, steps=20):
    """Error and R2 of the score one gap ago against the month prior, and the best mix of both."""
    s = weekly.select(KEY, WEEK, "month", "score")
    g = gaps.withColumn("_g", F.greatest(F.lit(4), F.bround("gap_weeks").cast("int")))
    sizes = s.groupBy(KEY).agg(F.count("*").alias("_n"), F.avg("score").alias("_rm"))
    months = s.groupBy(KEY, "month").agg(F.count("*").alias("_k"), F.avg("score").alias("_mm"))
    base = s.join(g, KEY).join(sizes, KEY).filter(F.col("_n") >= F.col("_g") + 2).join(months, [KEY, "month"])
    prior = F.when(F.col("_k") >= 3, F.col("_mm")).otherwise(F.col("_rm"))
    earlier = s.join(g, KEY).select(KEY, (F.col(WEEK) + F.col("_g")).alias(WEEK), F.col("score").alias("lagged"))
    rows = base.withColumn("prior", prior).join(earlier, [KEY, WEEK])
    mixes = {i: f"avg(abs({i / steps} * lagged + {1 - i / steps} * prior - score)) AS mix{i}" for i in range(steps + 1)}
    def report(df, scope):
        one = df.agg(
            F.count("*").alias("n"), F.avg(F.abs(F.col("lagged") - F.col("score"))).alias("mae_lag"),
            F.avg(F.abs(F.col("prior") - F.col("score"))).alias("mae_prior"),
            F.avg(F.pow(F.col("lagged") - F.col("score"), 2)).alias("_l"), F.avg(F.pow(F.col("prior") - F.col("score"), 2)).alias("_p"),
            F.var_pop("score").alias("_v"), *[F.expr(e) for e in mixes.values()])
        best = F.array_min(F.array(*[F.struct(F.col(f"mix{i}").alias("mae"), F.lit(i / steps).alias("alpha")) for i in mixes]))
        return one.select(F.lit(scope).alias("scope"), "n", "mae_lag", "mae_prior",
                          (1 - F.try_divide("_l", "_v")).alias("r2_lag"), (1 - F.try_divide("_p", "_v")).alias("r2_prior"),
                          best["alpha"].alias("best_alpha"), best["mae"].alias("best_mae"))
    return report(rows, "all").unionByName(report(rows.filter(F.col("gap_weeks") >= long_gap), "long"))


def feature_target_correlations(df, features, targets):
    one = df.agg(*[corr(f, t).alias(f"{f}|{t}") for f in features for t in targets])
    long = one.unpivot([], [f"`{f}|{t}`" for f in features for t in targets], "pair", "corr")
    both = F.split("pair", "\\|")
    return long.select(both[0].alias("feature"), both[1].alias("target"), "corr")


def findings(frames):
    """Union of report tables as rows (section, metric, key, value).

    `frames` maps a section to (table, key columns); every other column is a metric.
    """
    out = None
    for section, (df, keys) in frames.items():
        metrics = [c for c, t in df.dtypes if c not in keys and t not in ("string", "boolean") and not t.startswith("array")]
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        long = df.select(key.alias("key"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
            ["key"], metrics, "metric", "value").withColumn("section", F.lit(section))
        out = long if out is None else out.unionByName(long)
    return out.select("section", "metric", "key", "value")
