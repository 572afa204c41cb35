"""Physical indices and composite frames."""
from pyspark.sql import functions as F

from panelcast.config import ANOMALY_CHANNELS, CHANNELS, ROLL_DAYS, TREND_COLUMNS
from panelcast.operators import climatology as cl, indices as ix, lags as lg
from panelcast.operators.rolling import weekly_frames
from panelcast.plans.base import query
from panelcast.plans.climatology import BASE, BASE_SQL, METEO, METEO_COLS, WOY, WOY_COLS, _median_filled
from panelcast.plans.inputs import train, weekly, weekly_test
from panelcast.plans.lags import LAG_SQL, ORD_SQL
from panelcast.plans.weekly import DAYFRAMES, WEEKFRAMES

WK = "region_id:s week_idx:i "
W3 = (4, 8, 12)
VPD, DTR = "(tmp_mean - wb_tmp_mean)", "(tmp_max_mean - tmp_min_mean)"


@query("idx_vpd_dtr", WK + "vpd dtr " + " ".join(f"vpd_roll{w} dtr_roll{w}" for w in W3),
       f"SELECT region_id, week_idx, {VPD} vpd, {DTR} dtr, " + ", ".join(
           f"avg({VPD}) OVER w{w} vpd_roll{w}, avg({DTR}) OVER w{w} dtr_roll{w}" for w in W3) + f" FROM wk WINDOW {WEEKFRAMES}")
def idx_vpd_dtr(spark, d):
    return weekly_frames(weekly(spark, d), ix.vpd_dtr(), 11)


def _phys(w):
    return (f"avg(CAST(coalesce(prec < 0.1, false) AS INT)) OVER w{w} dry_day_frac_{w}d, avg(CASE WHEN tmp IS NOT NULL THEN greatest(tmp-10, 0) END) OVER w{w} heat_dd_{w}d, "
            f"avg(tmp-wb_tmp) OVER w{w} vpd_mean_{w}d, max(tmp-wb_tmp) OVER w{w} vpd_max_{w}d, avg(100-humidity) OVER w{w} hum_aridity_idx_{w}d, "
            f"mu*count(*) OVER w{w} - coalesce(sum(prec) OVER w{w}, 0) prec_deficit_{w}d, avg(tmp_max-tmp_min) OVER w{w} dtr_mean_{w}d, "
            f"coalesce(sum(prec) OVER w{w}, 0) prec_sum_{w}d")


@query("idx_physical", "region_id:s day_idx:i " + " ".join(f"{n}_{w}d" for w in ROLL_DAYS for n in ix.PHYSICAL),
       "SELECT region_id, day_idx, " + ", ".join(_phys(w) for w in ROLL_DAYS)
       + f" FROM train JOIN (SELECT region_id, avg(prec) mu FROM train GROUP BY 1) USING (region_id) WINDOW {DAYFRAMES}")
def idx_physical(spark, d):
    t = train(spark, d)
    return ix.physical_windows(t, cl.region_meteo(t))


def _signals(w):
    return ", ".join([
        f"coalesce((avg(tmp-wb_tmp) OVER w{w} - (tmp_mu-wb_tmp_mu))/greatest(tmp_sd+wb_tmp_sd, 0.5), 0) sig_vpd_{w}",
        f"(prec_mu*count(*) OVER w{w} - coalesce(sum(prec) OVER w{w}, 0))/greatest(greatest(prec_sd, 0.01)*sqrt(count(*) OVER w{w}), 0.1) sig_deficit_{w}",
        f"avg(CAST(coalesce(prec < 0.1, false) AS INT)) OVER w{w} sig_dry_{w}",
        f"coalesce(avg(CASE WHEN tmp IS NOT NULL THEN greatest(tmp-10, 0) END) OVER w{w}/greatest(tmp_mu-10, 0.5), 0) sig_heat_{w}",
        f"coalesce((avg(humidity) OVER w{w} - humidity_mu)/greatest(humidity_sd, 0.5), 0) sig_hum_{w}",
        f"coalesce((avg(tmp) OVER w{w} - tmp_mu)/greatest(tmp_sd, 0.5), 0) sig_tmp_{w}",
        f"coalesce((avg(tmp_max-tmp_min) OVER w{w} - tmp_range_mu)/greatest(tmp_range_sd, 0.5), 0) sig_dtr_{w}"])


SIG_SQL = ("SELECT region_id, day_idx, score, " + ", ".join(_signals(w) for w in (7, 21, 91))
           + f" FROM train JOIN (SELECT region_id, {BASE} FROM train GROUP BY 1) USING (region_id) WINDOW {DAYFRAMES}")


def signals(spark, d):
    t = train(spark, d)
    return ix.proxy_signals(t, cl.region_meteo(t))


@query("idx_proxy7", "region_id:s day_idx:i " + " ".join(ix.signal_names()), SIG_SQL)
def idx_proxy7(spark, d):
    return signals(spark, d)


COEF = [round(0.02 * (i % 7 + 1) * (-1) ** i, 4) for i in range(21)]
SEG = {w: " + ".join(f"{n}*{k}" for n, k in zip(ix.signal_names()[i * 7:i * 7 + 7], COEF[i * 7:i * 7 + 7]))
       for i, w in enumerate((7, 21, 91))}
CL = lambda e: f"least(greatest({e}, 0), 5)"
P = {w: CL(f"{SEG[w]} + 0.9/3") for w in SEG}


@query("ml_proxy_score", "region_id:s day_idx:i proxy_p7 proxy_p21 proxy_p91 proxy_main proxy_7_91 proxy_21_91 proxy_7_21", f"""
SELECT region_id, day_idx, {P[7]} proxy_p7, {P[21]} proxy_p21, {P[91]} proxy_p91,
  {CL(" + ".join(SEG.values()) + " + 0.9")} proxy_main, {P[7]} - {P[91]} proxy_7_91, {P[21]} - {P[91]} proxy_21_91, {P[7]} - {P[21]} proxy_7_21
FROM ({SIG_SQL})""")
def ml_proxy_score(spark, d):
    return signals(spark, d).withColumns(ix.proxy_scores(COEF, 0.9))


@query("idx_deficit", WK + " ".join(f"prec_deficit{w} heat_dd{w} aridity{w}" for w in W3),
       "SELECT region_id, week_idx, " + ", ".join(
           f"prec_sum_bmean - avg(prec_sum) OVER w{w} prec_deficit{w}, CASE WHEN avg(tmp_mean) OVER w{w} IS NOT NULL THEN "
           f"greatest(avg(tmp_mean) OVER w{w} - tmp_mean_bmean, 0) END heat_dd{w}, "
           f"(humidity_mean_bmean - avg(humidity_mean) OVER w{w})/(humidity_mean_bstd + 1e-6) aridity{w}" for w in W3)
       + f" FROM wk JOIN ({BASE_SQL}) USING (region_id) WINDOW {WEEKFRAMES}")
def idx_deficit(spark, d):
    w = weekly(spark, d)
    return weekly_frames(w.join(ix.region_base(w), "region_id", "left"), ix.deficits(), 11)


@query("idx_spi_causal", WK + " ".join(f"spi_{w}" for w in W3),
       "SELECT region_id, week_idx, " + ", ".join(
           f"CASE WHEN count(prec_sum) OVER w12 >= 2 THEN (avg(prec_sum) OVER w{w} - avg(prec_sum) OVER w12)/(stddev_samp(prec_sum) OVER w12 + 1e-6) END spi_{w}" for w in W3)
       + f" FROM wk WINDOW {WEEKFRAMES}")
def idx_spi_causal(spark, d):
    return weekly_frames(weekly(spark, d), ix.causal_spi(), 11)


PET = {"hargreaves": "(tmp_mean+17.8)*sqrt(CASE WHEN tmp_max_mean IS NOT NULL THEN greatest(tmp_max_mean-tmp_min_mean, 0) END)*7",
       "vpd": "CASE WHEN tmp_mean IS NOT NULL THEN greatest(tmp_mean-wb_tmp_mean, 0) END*7", "none": "0"}


@query("idx_pet", WK + " ".join(f"pet_{m}:r d_{m}:r" for m in PET),
       "SELECT region_id, week_idx, " + ", ".join(f"{e} pet_{m}, prec_sum - {e} d_{m}" for m, e in PET.items()) + " FROM wk")
def idx_pet(spark, d):
    """The three evaporation models."""
    out = weekly(spark, d)
    for m in PET:
        out = (ix.with_balance(out, m).withColumns({f"pet_{m}": F.col("PET"), f"d_{m}": F.col("D")})
               .drop("P", "PET", "D"))
    return out


BAL = f"SELECT *, prec_sum P, {PET['vpd']} PET, prec_sum - {PET['vpd']} D FROM "


def cums(src, series, scales, k0):
    return (f"SELECT *, " + ", ".join(
        f"CASE WHEN count({c}) OVER w{s} >= {max(k0, s // 2)} THEN sum({c}) OVER w{s} END cum_{c}_{s}" for c in series for s in scales)
        + f" FROM ({src}) WINDOW {WEEKFRAMES}")


def zs(src, series, scales):
    return "SELECT *, " + ", ".join(
        f"(cum_{c}_{s} - avg(cum_{c}_{s}) OVER r)/CASE WHEN coalesce(stddev_samp(cum_{c}_{s}) OVER r, 0) = 0 THEN 1 ELSE stddev_samp(cum_{c}_{s}) OVER r END z_{c}_{s}"
        for c in series for s in scales) + f" FROM ({src}) WINDOW r AS (PARTITION BY region_id)"


S3 = (12, 26, 52)
SPEI = zs(cums(BAL + "wk", ["D"], S3, 4), ["D"], S3)
AVG3 = "list_avg(list_filter([z_D_12, z_D_26, z_D_52], lambda x: x IS NOT NULL))"


@query("idx_spei_train", WK + "z_D_12 z_D_26 z_D_52 spei", f"SELECT *, {AVG3} AS spei FROM ({SPEI})")
def idx_spei_train(spark, d):
    return ix.spei_train(ix.with_balance(weekly(spark, d)))


def tail(series, scales):
    both = (f"SELECT region_id, week_idx, {', '.join(series)} FROM ({BAL} wk) UNION ALL "
            f"SELECT region_id, week_idx + 344, {', '.join(series)} FROM ({BAL} wtest)")
    return ("SELECT region_id, " + ", ".join(f"sum({c}) FILTER (rk <= {s}) cum_{c}_{s}" for c in series for s in scales) + ", "
            + ", ".join(f"avg({c}) FILTER (rk <= 4) recent_{c}" for c in series)
            + f" FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY week_idx DESC) rk FROM ({both})) GROUP BY 1")


def tail_z(series, scales, k0):
    stats = ("SELECT region_id, " + ", ".join(f"avg(cum_{c}_{s}) m_{c}_{s}, stddev_samp(cum_{c}_{s}) s_{c}_{s}" for c in series for s in scales)
             + f" FROM ({cums(BAL + 'wk', series, scales, k0)}) GROUP BY 1")
    return ("SELECT *, " + ", ".join(
        f"(cum_{c}_{s} - m_{c}_{s})/CASE WHEN coalesce(s_{c}_{s}, 0) = 0 THEN 1 ELSE s_{c}_{s} END z_{c}_{s}" for c in series for s in scales)
        + f" FROM ({tail(series, scales)}) JOIN ({stats}) USING (region_id)")


@query("idx_spei_test", "region_id:s z_D_12 z_D_26 z_D_52 spei", f"SELECT *, {AVG3} AS spei FROM ({tail_z(['D'], S3, 4)})")
def idx_spei_test(spark, d):
    return ix.spei_test(ix.with_balance(weekly(spark, d)), ix.with_balance(weekly_test(spark, d)))


TRENDS = "z_D_4 - z_D_52 ztrend_D, z_P_4 - z_P_52 ztrend_P"


MULTI_COLS = " ".join(c + ":r" if c.startswith("rb_") else c for c in ix.MULTI)


@query("idx_multi", WK + MULTI_COLS, f"""
  SELECT *, {TRENDS}, {", ".join(f"avg({c}) OVER w4 - avg({c}) OVER r rb_{c}" for c in ("PET", "D", "P"))}
  FROM ({zs(cums(BAL + "wk", ix.SERIES, ix.SCALES, 2), ix.SERIES, ix.SCALES)}) WINDOW {WEEKFRAMES}, r AS (PARTITION BY region_id)""")
def idx_multi(spark, d):
    return ix.multi_scale(ix.with_balance(weekly(spark, d)))


@query("idx_multi_test", "region_id:s " + MULTI_COLS, f"""
SELECT t.*, {TRENDS}, recent_PET - m_PET rb_PET, recent_D - m_D rb_D, recent_P - m_P rb_P
FROM ({tail_z(ix.SERIES, ix.SCALES, 2)}) t
JOIN (SELECT region_id, avg(PET) m_PET, avg(D) m_D, avg(P) m_P FROM ({BAL} wk) GROUP BY 1) USING (region_id)""")
def idx_multi_test(spark, d):
    return ix.multi_scale_test(ix.with_balance(weekly(spark, d)), ix.with_balance(weekly_test(spark, d)))


@query("idx_interact", WK + "int_hot_dry int_prec_humid", """
SELECT region_id, week_idx, tmp_max_mean*(1-humidity_mean) int_hot_dry, prec_mean*humidity_mean int_prec_humid FROM wk""")
def idx_interact(spark, d):
    return weekly(spark, d).withColumns(ix.interactions("_mean"))


EXTRA = WOY_COLS + [f"anom_{c}" for c in ANOMALY_CHANNELS] + [f"slope{n}_{b}" for b in TREND_COLUMNS for n in (4, 8)] + ["int_hot_dry", "int_prec_humid"]


def _slope(b, n):
    mid, var = (n - 1) / 2, sum((i - (n - 1) / 2) ** 2 for i in range(n))
    return "(" + " + ".join(f"{b}_lag{k}*({n - k - mid})" for k in range(1, n + 1)) + f")/{var} AS slope{n}_{b}"


ASSEMBLED = f"""WITH l AS (SELECT *, least(52, (doy-1)//7) AS woy FROM ({LAG_SQL})),
j AS (SELECT l.*, {", ".join(WOY_COLS + METEO_COLS)} FROM l LEFT JOIN ({WOY} GROUP BY 1, 2) USING (region_id, woy)
  LEFT JOIN ({METEO} GROUP BY 1, 2) USING (region_id, woy)),
k AS ({_median_filled(WOY_COLS + METEO_COLS[:6], "SELECT * FROM j")})
SELECT *, {", ".join(f"({c}_mean_lag0 - clim_{c}_mean)/greatest(coalesce(clim_{c}_std, 1e-3), 1e-3) AS anom_{c}" for c in ANOMALY_CHANNELS)},
  {", ".join(_slope(b, n) for b in TREND_COLUMNS for n in (4, 8))},
  tmp_max_mean_lag0*(1-humidity_mean_lag0) AS int_hot_dry, prec_mean_lag0*humidity_mean_lag0 AS int_prec_humid FROM k"""


@query("feat_assemble", WK + " ".join(EXTRA), ASSEMBLED)
def feat_assemble(spark, d):
    w = weekly(spark, d)
    return ix.extra_blocks(lg.lag_matrix(w), cl.woy_score(w), cl.woy_meteo(w), TREND_COLUMNS)


FRAME_CH = ["tmp", "tmp_max", "tmp_min", "wb_tmp", "prec", "humidity"]
FRAME_CHECK = ["tmp_roll8_mean", "tmp_roll8_std", "prec_anom_sl", "humidity_ranom4", "vpd_roll12", "prec_deficit8", "heat_dd4",
               "spi_8", "doy_sin", "month_cos"]
FRAME_SQL = f"""SELECT region_id, week_idx, month, score, ord, avg(tmp_mean) OVER w8 tmp_roll8_mean, CASE WHEN count(tmp_mean) OVER w8 >= 2 THEN stddev_samp(tmp_mean) OVER w8 END tmp_roll8_std,
  avg(prec_mean) OVER w4 - avg(prec_mean) OVER w12 prec_anom_sl, (avg(humidity_mean) OVER w4 - humidity_mean_bmean)/(humidity_mean_bstd + 1e-6) humidity_ranom4,
  avg({VPD}) OVER w12 vpd_roll12, prec_sum_bmean - avg(prec_sum) OVER w8 prec_deficit8,
  CASE WHEN avg(tmp_mean) OVER w4 IS NOT NULL THEN greatest(avg(tmp_mean) OVER w4 - tmp_mean_bmean, 0) END heat_dd4,
  CASE WHEN count(prec_sum) OVER w12 >= 2 THEN (avg(prec_sum) OVER w8 - avg(prec_sum) OVER w12)/(stddev_samp(prec_sum) OVER w12 + 1e-6) END spi_8,
  sin(2*pi()*doy366/366) doy_sin, cos(2*pi()*month/12) month_cos FROM wk JOIN ({BASE_SQL}) USING (region_id) WINDOW {WEEKFRAMES}"""


@query("feat_frame", WK + " ".join(FRAME_CHECK), FRAME_SQL)
def feat_frame(spark, d):
    """Some columns of the whole shift-aware frame."""
    w = weekly(spark, d)
    return ix.shift_aware_frame(w, ix.region_base(w))


@query("feat_pool", WK + "spi_8 region_score_mean region_score_p90 region_month_score_mean", f"""
SELECT f.region_id, f.week_idx, f.spi_8, coalesce(r.m, g.m) region_score_mean, coalesce(r.p, g.p) region_score_p90,
  coalesce(c.m, r.m, g.m) region_month_score_mean
FROM ({FRAME_SQL}) f
LEFT JOIN (SELECT region_id, avg(score) m, quantile_cont(score, 0.9) p FROM wk GROUP BY 1) r USING (region_id)
LEFT JOIN (SELECT region_id, month, avg(score) m FROM wk GROUP BY 1, 2) c USING (region_id, month)
CROSS JOIN (SELECT avg(score) m, quantile_cont(score, 0.9) p FROM wk) g""")
def feat_pool(spark, d):
    """Pool-fitted scalars beside the frame."""
    w = weekly(spark, d)
    f = ix.shift_aware_frame(w, ix.region_base(w)).select("region_id", "week_idx", "month", "spi_8")
    return cl.season_scalars(cl.region_scalars(f, w), w)


STATCOLS = [f"{c}_{s}" for c in CHANNELS for s in ("mean", "std", "min", "max", "sum", "p95")]


@query("filt_nonkey", "column_name:s n_values:i",
       f"UNPIVOT (SELECT {', '.join(f'count({c}) AS {c}' for c in STATCOLS)} FROM wk) ON {', '.join(STATCOLS)} INTO NAME column_name VALUE n_values")
def filt_nonkey(spark, d):
    """Values per feature column once keys and targets are left out."""
    w = weekly(spark, d)
    cols = ix.feature_columns(w)
    counts = w.agg(*[F.count(c).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "n_values")


@query("idx_eda_signals", "region_id:s day_idx:i vpd_anom prec_deficit dry_day:i", """
SELECT region_id, day_idx, (tmp-wb_tmp-(SELECT avg(tmp-wb_tmp) FROM train))/(SELECT greatest(stddev_samp(tmp-wb_tmp), 0.1) FROM train) vpd_anom,
  ((SELECT avg(prec) FROM train)-prec)/(SELECT greatest(stddev_samp(prec), 0.01) FROM train) prec_deficit,
  CAST(coalesce(prec < 0.1, false) AS INT) dry_day
FROM train""")
def idx_eda_signals(spark, d):
    return ix.daily_signals(train(spark, d))
