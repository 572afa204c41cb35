"""Physical indices, anomalies of weekly windows and the composite feature frames."""
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, KEY, ROLL_DAYS, ROLL_WEEKS, WEEK
from panelcast.functions.blocks import rolling_stats
from panelcast.functions.chunks import over
from panelcast.operators import climatology as clim
from panelcast.operators.rolling import lag_slope, rolling_weeks, weekly_frames

EPS = 1e-6
NON_FEATURES = {KEY, "region_idx", WEEK, "day_idx", "ord", "doy", "doy366", "month", "woy", "woy1", "score",
                "test_woy", "test_woy1", "woy_dist", *[f"target_w{h}" for h in range(1, 6)]}


def region_base(weekly, channels=CHANNELS):
    """Mean and sample deviation (0 when unknown) of the weekly means and of the weekly rain."""
    cols = [f"{c}_mean" for c in channels] + ["prec_sum"]
    return weekly.groupBy(KEY).agg(*[F.expr(f"avg({c}) AS {c}_bmean") for c in cols],
                                   *[F.expr(f"coalesce(stddev_samp({c}), 0D) AS {c}_bstd") for c in cols])


def local_anomalies(channels=CHANNELS, windows=ROLL_WEEKS):
    """Short minus long rolling mean, and the week against its own trailing long window."""
    short, long = over(KEY, WEEK, windows[0] - 1), over(KEY, WEEK, windows[-1] - 1)
    out = {}
    for c in channels:
        m = f"{c}_mean"
        sd = f"CASE WHEN count({m}) {long} >= 2 THEN stddev_samp({m}) {long} END"
        out[f"{c}_anom_sl"] = F.expr(f"avg({m}) {short} - avg({m}) {long}")
        out[f"{c}_anom_z"] = F.expr(f"({m} - avg({m}) {long}) / ({sd} + {EPS}D)")
    return out


def region_anomalies(channels=CHANNELS, windows=ROLL_WEEKS):
    return {f"{c}_ranom{w}": F.expr(f"(avg({c}_mean) {over(KEY, WEEK, w - 1)} - {c}_mean_bmean)"
                                    f" / ({c}_mean_bstd + {EPS}D)") for w in windows for c in channels}


def vpd_dtr(windows=ROLL_WEEKS):
    vpd, dtr = "(tmp_mean - wb_tmp_mean)", "(tmp_max_mean - tmp_min_mean)"
    out = {"vpd": F.expr(vpd), "dtr": F.expr(dtr)}
    for w in windows:
        f = over(KEY, WEEK, w - 1)
        out[f"vpd_roll{w}"] = F.expr(f"avg({vpd}) {f}")
        out[f"dtr_roll{w}"] = F.expr(f"avg({dtr}) {f}")
    return out


def deficits(windows=ROLL_WEEKS):
    """Rain below, heat above and air drier than the region's normal."""
    out = {}
    for w in windows:
        f = over(KEY, WEEK, w - 1)
        out[f"prec_deficit{w}"] = F.expr(f"prec_sum_bmean - avg(prec_sum) {f}")
        heat = f"avg(tmp_mean) {f} - tmp_mean_bmean"
        out[f"heat_dd{w}"] = F.expr(f"CASE WHEN {heat} < 0 THEN 0D ELSE {heat} END")
        out[f"aridity{w}"] = F.expr(f"(humidity_mean_bmean - avg(humidity_mean) {f}) / (humidity_mean_bstd + {EPS}D)")
    return out


def causal_spi(windows=ROLL_WEEKS):
    """Rolling rain against the series' own trailing long window."""
    f = over(KEY, WEEK, windows[-1] - 1)
    enough = f"count(prec_sum) {f} >= 2"
    mean = f"CASE WHEN {enough} THEN avg(prec_sum) {f} END"
    sd = f"CASE WHEN {enough} THEN stddev_samp(prec_sum) {f} END"
    return {f"spi_{w}": F.expr(f"(avg(prec_sum) {over(KEY, WEEK, w - 1)} - {mean}) / ({sd} + {EPS}D)") for w in windows}


def calendar_terms():
    return {n: F.expr(f"{fn}(2 * pi() * {c} / {p}D)") for n, fn, c, p in (
        ("doy_sin", "sin", "doy366", 366), ("doy_cos", "cos", "doy366", 366),
        ("month_sin", "sin", "month", 12), ("month_cos", "cos", "month", 12))}


def shift_aware_frame(weekly, base, channels=CHANNELS, windows=ROLL_WEEKS):
    """Weekly rows with rolling levels, all anomalies, physical terms and calendar terms.

    All windows share one chunked partitioning."""
    joined = weekly.join(base, KEY, "left")
    exprs = {**rolling_weeks({c: f"{c}_mean" for c in channels}, windows), **local_anomalies(channels, windows),
             **region_anomalies(channels, windows), **vpd_dtr(windows), **deficits(windows), **causal_spi(windows),
             **calendar_terms()}
    drop = [f"{c}_{s}" for c in [f"{c}_mean" for c in channels] + ["prec_sum"] for s in ("bmean", "bstd")]
    return weekly_frames(joined, exprs, windows[-1] - 1).drop(*drop)


def feature_columns(df):
    """Numeric columns that are neither keys nor targets."""
    return [n for n, t in df.dtypes if n not in NON_FEATURES and t not in ("string", "boolean")]


def interactions(suffix="_mean_lag0"):
    return {"int_hot_dry": F.col(f"tmp_max{suffix}") * (1.0 - F.col(f"humidity{suffix}")),
            "int_prec_humid": F.col(f"prec{suffix}") * F.col(f"humidity{suffix}")}


def slope_over_lags(base, n):
    """Least-squares slope over the columns <base>_lag1..n."""
    centre = (n - 1) / 2
    spread = sum((i - centre) ** 2 for i in range(n))
    return F.expr("(" + " + ".join(f"{base}_lag{k} * {n - k - centre}D" for k in range(1, n + 1)) + f") / {spread}D")


def extra_blocks(features, score_clim, meteo_clim, trend_columns):
    """Score climatology, weather anomalies, lag slopes and interactions, in this order."""
    df = clim.join_woy_score(features, score_clim)
    df = clim.woy_anomalies(df, meteo_clim)
    df = df.withColumns({f"slope{n}_{b}": slope_over_lags(b, n) for b in trend_columns for n in (4, 8)})
    return df.withColumns(interactions())


# Daily windows.
PHYSICAL = ["dry_day_frac", "heat_dd", "vpd_mean", "vpd_max", "hum_aridity_idx", "prec_deficit", "dtr_mean", "prec_sum"]


def _derived(daily):
    return daily.selectExpr("*", "CAST(coalesce(prec < 0.1D, false) AS DOUBLE) AS _dry",
                            "CASE WHEN tmp IS NOT NULL THEN greatest(tmp - 10, 0D) END AS _heat",
                            "tmp - wb_tmp AS _vpd", "100 - humidity AS _arid", "tmp_max - tmp_min AS _dtr")


def _physical_windows(windows):
    wanted = {}
    for w in windows:
        wanted.update({f"dry_day_frac_{w}d": ("_dry", "mean", w), f"heat_dd_{w}d": ("_heat", "mean", w),
                       f"vpd_mean_{w}d": ("_vpd", "mean", w), f"vpd_max_{w}d": ("_vpd", "max", w),
                       f"hum_aridity_idx_{w}d": ("_arid", "mean", w), f"dtr_mean_{w}d": ("_dtr", "mean", w),
                       f"prec_sum_{w}d": ("prec", "sum", w), f"_rows_{w}": ("prec", "rows", w)})
    return wanted


def physical_windows(daily, base, windows=ROLL_DAYS):
    """Dry days, heat, vapour deficit, aridity, rain deficit, daily range and rain per window."""
    df = rolling_stats(_derived(daily), _physical_windows(windows))
    df = df.join(base.select(KEY, F.col("prec_mu").alias("_mu")), KEY, "left")
    out = [f"coalesce(_mu, 0D) * _rows_{w} - prec_sum_{w}d AS prec_deficit_{w}d" for w in windows]
    return df.selectExpr("*", *out).drop("_mu", *[f"_rows_{w}" for w in windows],
                                         "_dry", "_heat", "_vpd", "_arid", "_dtr")


SIGNALS = ["vpd", "deficit", "dry", "heat", "hum", "tmp", "dtr"]


def proxy_signals(daily, base, windows=(7, 21, 91)):
    """Seven standardised dryness signals per window, 0 where a window has no values."""
    wanted = {}
    for w in windows:
        wanted.update({f"_v{w}": ("_vpd", "mean", w), f"_p{w}": ("prec", "sum", w), f"_r{w}": ("prec", "rows", w),
                       f"_d{w}": ("_dry", "mean", w), f"_h{w}": ("_heat", "mean", w), f"_u{w}": ("humidity", "mean", w),
                       f"_t{w}": ("tmp", "mean", w), f"_g{w}": ("_dtr", "mean", w)})
    df = rolling_stats(_derived(daily), wanted)
    # Normals and deviations used for a region without history.
    normal = {"tmp": (20, 5), "wb_tmp": (10, 3), "prec": (1, 1), "humidity": (60, 15), "tmp_range": (10, 3)}
    b = base.selectExpr(KEY, *[f"{c}_mu AS _mu_{c}" for c in normal], *[f"{c}_sd AS _sd_{c}" for c in normal])
    df = df.join(b, KEY, "left")
    mu = {c: f"coalesce(_mu_{c}, {m}D)" for c, (m, _) in normal.items()}
    sd = {c: f"coalesce(_sd_{c}, {s}D)" for c, (_, s) in normal.items()}
    out = []
    for w in windows:
        signal = {
            "vpd": f"(_v{w} - ({mu['tmp']} - {mu['wb_tmp']})) / greatest({sd['tmp']} + {sd['wb_tmp']}, 0.5D)",
            "deficit": f"({mu['prec']} * _r{w} - _p{w}) / greatest(greatest({sd['prec']}, 0.01D) * sqrt(_r{w}), 0.1D)",
            "dry": f"_d{w}", "heat": f"_h{w} / greatest({mu['tmp']} - 10, 0.5D)",
            "hum": f"(_u{w} - {mu['humidity']}) / greatest({sd['humidity']}, 0.5D)",
            "tmp": f"(_t{w} - {mu['tmp']}) / greatest({sd['tmp']}, 0.5D)",
            "dtr": f"(_g{w} - {mu['tmp_range']}) / greatest({sd['tmp_range']}, 0.5D)"}
        out += [f"coalesce({e}, 0D) AS sig_{n}_{w}" for n, e in signal.items()]
    helpers = [*wanted, "_dry", "_heat", "_vpd", "_arid", "_dtr", *b.columns[1:]]
    return df.selectExpr("*", *out).drop(*helpers)


def signal_names(windows=(7, 21, 91)):
    return [f"sig_{n}_{w}" for w in windows for n in SIGNALS]


def proxy_scores(coefficients, intercept, windows=(7, 21, 91)):
    """Segment scores, whole score and differences as expressions of the signals."""
    names = signal_names(windows)
    def dot(cols, coefs):
        return " + ".join(f"{c} * {float(k)!r}D" for c, k in zip(cols, coefs))
    out, n = {}, len(SIGNALS)
    for i, w in enumerate(windows):
        part = dot(names[i * n:(i + 1) * n], coefficients[i * n:(i + 1) * n])
        out[f"proxy_p{w}"] = f"least(greatest({part} + {float(intercept) / 3!r}D, 0D), 5D)"
    out["proxy_main"] = f"least(greatest({dot(names, coefficients)} + {float(intercept)!r}D, 0D), 5D)"
    a, b, c = (f"proxy_p{w}" for w in windows)
    out.update({f"proxy_{windows[0]}_{windows[2]}": f"{out[a]} - {out[c]}",
                f"proxy_{windows[1]}_{windows[2]}": f"{out[b]} - {out[c]}",
                f"proxy_{windows[0]}_{windows[1]}": f"{out[a]} - {out[b]}"})
    return {k: F.expr(v) for k, v in out.items()}


# Water balance.
def with_balance(weekly, pet="vpd"):
    """Weekly rain P, evaporative demand PET and balance D."""
    demand = {"hargreaves": "(tmp_mean + 17.8D) * sqrt(greatest(tmp_max_mean - tmp_min_mean, 0D)) * 7",
              "vpd": "greatest(tmp_mean - wb_tmp_mean, 0D) * 7", "none": "0D"}
    null_safe = {"hargreaves": "tmp_mean IS NOT NULL AND tmp_max_mean IS NOT NULL",
                 "vpd": "tmp_mean IS NOT NULL AND wb_tmp_mean IS NOT NULL", "none": "true"}
    if pet not in demand:
        raise ValueError(f"unknown method {pet!r}")
    out = weekly.selectExpr("*", "prec_sum AS P", f"CASE WHEN {null_safe[pet]} THEN {demand[pet]} END AS PET")
    return out.withColumn("D", F.col("P") - F.col("PET"))


def cumulated(weekly, series, scales, floor):
    """Trailing sums cum_<series>_<scale> with at least max(floor, scale // 2) values."""
    out = {}
    for c in series:
        for s in scales:
            f = over(KEY, WEEK, s - 1)
            out[f"cum_{c}_{s}"] = F.expr(f"CASE WHEN count({c}) {f} >= {max(floor, s // 2)} THEN sum({c}) {f} END")
    return weekly_frames(weekly, out, max(scales) - 1)


def cumulated_stats(cum, series, scales):
    """Mean and sample deviation of the trailing sums per region."""
    names = [f"cum_{c}_{s}" for c in series for s in scales]
    return cum.groupBy(KEY).agg(*[F.expr(f"avg({n}) AS {n}_m") for n in names],
                                *[F.expr(f"stddev_samp({n}) AS {n}_s") for n in names])


def standardized(rows, stats, series, scales):
    """z_<series>_<scale>; a missing or zero deviation counts as 1, an unknown region as mean 0."""
    joined = rows.join(stats, KEY, "left")
    exprs = []
    for c in series:
        for s in scales:
            n = f"cum_{c}_{s}"
            sd = f"CASE WHEN coalesce({n}_s, 0D) = 0 THEN 1D ELSE {n}_s END"
            exprs.append(f"({n} - coalesce({n}_m, 0D)) / ({sd}) AS z_{c}_{s}")
    return joined.selectExpr("*", *exprs).drop(*[f"cum_{c}_{s}_{k}" for c in series for s in scales for k in "ms"])


def tail_sums(train_weekly, test_weekly, series, scales, recent=4):
    """Sums of the last `scale` weeks of train and test history together, and recent means."""
    both = train_weekly.select(KEY, WEEK, F.lit(False).alias("_ahead"), *series).unionByName(
        test_weekly.select(KEY, WEEK, F.lit(True).alias("_ahead"), *series))
    # Weeks are 0-based without holes in each part, so the rank from the end is arithmetic.
    sizes = both.groupBy(KEY).agg(F.max(F.when(F.col("_ahead"), F.col(WEEK))).alias("_last"),
                                  F.max(F.when(~F.col("_ahead"), F.col(WEEK))).alias("_train_last"))
    j = both.join(sizes.filter(F.col("_last").isNotNull()), KEY)
    back = F.when(F.col("_ahead"), F.col("_last") - F.col(WEEK)).otherwise(
        F.col("_last") + 1 + F.col("_train_last") - F.col(WEEK))
    j = j.withColumn("_back", back)
    return j.groupBy(KEY).agg(
        *[F.expr(f"sum(CASE WHEN _back < {s} THEN {c} END) AS cum_{c}_{s}") for c in series for s in scales],
        *[F.expr(f"avg(CASE WHEN _back < {recent} THEN {c} END) AS recent_{c}") for c in series])


def spei_train(weekly, scales=(12, 26, 52)):
    cum = cumulated(weekly, ["D"], scales, 4)
    out = standardized(cum, cumulated_stats(cum, ["D"], scales), ["D"], scales)
    return out.withColumn("spei", _mean_of([F.col(f"z_D_{s}") for s in scales]))


def _mean_of(cols):
    """Mean of the non-null values."""
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def spei_test(train_weekly, test_weekly, scales=(12, 26, 52)):
    """Balance of the last weeks up to the end of the test part, in train units."""
    stats = cumulated_stats(cumulated(train_weekly, ["D"], scales, 4), ["D"], scales)
    out = standardized(tail_sums(train_weekly, test_weekly, ["D"], scales), stats, ["D"], scales)
    return out.withColumn("spei", _mean_of([F.col(f"z_D_{s}") for s in scales]))


SERIES, SCALES = ["P", "D", "PET"], [4, 12, 26, 52]
MULTI = [f"z_{c}_{s}" for c in SERIES for s in SCALES] + ["ztrend_D", "ztrend_P"] + [f"rb_{c}" for c in ("PET", "D", "P")]


def _trends(df):
    return df.withColumns({f"ztrend_{c}": F.col(f"z_{c}_4") - F.col(f"z_{c}_52") for c in ("D", "P")})


def multi_scale(weekly):
    """Standardised sums of rain, balance and demand, their trends, and recent anomalies."""
    cum = cumulated(weekly, SERIES, SCALES, 2)
    out = _trends(standardized(cum, cumulated_stats(cum, SERIES, SCALES), SERIES, SCALES))
    base = weekly.groupBy(KEY).agg(*[F.avg(c).alias(f"_rb_{c}") for c in SERIES])
    f = over(KEY, WEEK, 3)
    exprs = {f"rb_{c}": F.expr(f"avg({c}) {f} - _rb_{c}") for c in SERIES}
    return weekly_frames(out.join(base, KEY), exprs, 3).drop(*[f"_rb_{c}" for c in SERIES])


def multi_scale_test(train_weekly, test_weekly):
    stats = cumulated_stats(cumulated(train_weekly, SERIES, SCALES, 2), SERIES, SCALES)
    out = _trends(standardized(tail_sums(train_weekly, test_weekly, SERIES, SCALES), stats, SERIES, SCALES))
    base = train_weekly.groupBy(KEY).agg(*[F.avg(c).alias(f"_rb_{c}") for c in SERIES])
    out = out.join(base, KEY, "left")
    return out.withColumns({f"rb_{c}": F.col(f"recent_{c}") - F.coalesce(f"_rb_{c}", F.lit(0.0)) for c in SERIES})


def daily_signals(daily):
    """Vapour-deficit anomaly and rain deficit in units of the whole panel, and the dry-day flag."""
    from panelcast.operators.cleaning import attach
    df = daily.withColumn("vpd", F.col("tmp") - F.col("wb_tmp"))
    fit = df.agg(F.avg("vpd").alias("vm"), F.greatest(F.stddev_samp("vpd"), F.lit(0.1)).alias("vs"),
                 F.avg("prec").alias("pm"), F.greatest(F.stddev_samp("prec"), F.lit(0.01)).alias("ps"))
    df = attach(df, fit, "_f")
    return df.withColumns({"vpd_anom": (F.col("vpd") - F.col("_f.vm")) / F.col("_f.vs"),
                           "prec_deficit": (F.col("_f.pm") - F.col("prec")) / F.col("_f.ps"),
                           "dry_day": F.coalesce(F.col("prec") < 0.1, F.lit(False)).cast("int")}).drop("_f")
