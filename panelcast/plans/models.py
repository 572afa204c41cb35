"""Model queries: profile tables and rules have SQL, fits return rows only."""
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, HORIZONS
from panelcast.functions.calendar import cyclic
from panelcast.operators import blend as bl, boosting as bo, climatology as cl, gaps, indices as ix, lags as lg, metrics as mt
from panelcast.operators import models as ml, normal as no, sequence_fit as sf, splits as sp, weekly as wk, weights as wt
from panelcast.plans.base import query
from panelcast.plans.indices import FRAME_SQL, signals
from panelcast.plans.inputs import aligned, anchors, clusters, gapped_train, members, test, train, weekly, weekly_test
from panelcast.plans.splits import calendar, last_test_week, meta
from panelcast.plans.weekly import CH15, KERNELS, imputed

PREDS = "region_id:s " + " ".join(f"pred_week{h}" for h in HORIZONS)
FEATURES = [f"{c}_mean" for c in CHANNELS] + ["prec_sum", "tmp_p95", "prec_std"] + lg.SCORE_HISTORY


def feature_rows(spark, d, weeks=None):
    """Weekly features with score history and targets, written once."""
    w = lg.with_score_history(weekly(spark, d) if weeks is None else weeks)
    return ml.store(lg.lead_targets(w).select("region_id", "week_idx", "month", "woy", "ord", "score", *FEATURES,
                                              *lg.TARGETS), "features")


def long_features(spark, d, weeks=None):
    return mt.long_targets(feature_rows(spark, d, weeks))


@query("ml_proxy_ridge", "term:s value")
def ml_proxy_ridge(spark, d):
    """Signals of the day before each scored day, against the score; days that lack a signal are left out."""
    cols = ix.signal_names()
    s = ml.store(signals(spark, d).select("region_id", "day_idx", "score", *cols), "signals")
    before = s.select("region_id", (F.col("day_idx") + 1).alias("day_idx"), *cols)
    picked = s.select("region_id", "day_idx", "score").filter("score IS NOT NULL")
    rows = ml.store(picked.join(before, ["region_id", "day_idx"]).na.drop(subset=cols), "proxy")
    return ml.coefficients(spark, ml.ridge(rows, cols, "score", 1.0), cols)


def frame(spark, d):
    w = weekly(spark, d)
    f = ix.shift_aware_frame(w, ix.region_base(w))
    return ml.store(lg.lead_targets(f), "frame")


@query("ml_proxy_scales", "region_id:s week_idx:i proxy_p4 proxy_p8 proxy_p12 proxy_main proxy_4_12 proxy_8_12 proxy_4_8")
def ml_proxy_scales(spark, d):
    """Proxies of the newest in-season holdout, fitted on the pool, which ends 13 weeks around it."""
    f = ml.store(sp.season_holdout(frame(spark, d), last_test_week(spark, d)), "proxy-frame")
    return ml.proxy_scales(f.filter("part = 'train'"), f.filter("part = 'val'"))


@query("ml_lin_phys", PREDS)
def ml_lin_phys(spark, d):
    a, b = (ix.with_balance(x) for x in (weekly(spark, d), weekly_test(spark, d)))
    stats = cl.score_stats(a, ["region_id"], {"score_mean": "mean", "score_std": "std0", "zero_rate": "zero_rate"})
    cols = ix.MULTI + ["score_mean", "score_std", "zero_rate", "woy_sin", "woy_cos"]
    from panelcast.functions.calendar import cyclic
    def season(df):
        s, c = cyclic(F.col("woy1"), 52)
        return df.join(stats, "region_id", "left").withColumns({"woy_sin": s, "woy_cos": c})
    rows = ml.store(season(lg.lead_targets(ix.multi_scale(a))), "phys")
    ends = ix.multi_scale_test(a, b).join(lg.last_week(b).select("region_id", "woy1"), "region_id")
    return ml.linear_horizons(rows, ml.store(season(ends), "phys-test"), cols)


def lag_frame(spark, d):
    """(rows, columns) of the boosted fits: weekly statistics, score history and targets, written once.

    The whole lag frame has 358 columns; with it a query took 132 s at sf0.01, most of it for wide projections.
    """
    return feature_rows(spark, d), FEATURES


def boosted_split(spark, d):
    """(rows, columns): the features with severity weights, and targets by role: `fit_` in the pool, `stop_` on the newest
    fifth of the pool's in-season weeks, neither in the calendar holdout (`part` = val)."""
    frame, cols = lag_frame(spark, d)
    rows = sp.calendar_split(frame.select("region_id", "week_idx", "woy", "ord", *lg.TARGETS), meta(spark, d))
    rows = ml.store(sp.with_woy_distance(rows.drop("test_woy", "woy_dist"), meta(spark, d)), "roles")
    near = (F.col("part") == "train") & (F.col("woy_dist") <= 6)
    cut = rows.filter(near).agg(F.percentile_approx("ord", 0.8, 10000)).first()[0]
    stop = near & (F.col("ord") > (cut if cut is not None else 0))
    fit = (F.col("part") == "train") & ~F.coalesce(stop, F.lit(False))
    roles = {f"{n}_{h}": F.when(role, F.col(f"target_w{h}")) for n, role in (("fit", fit), ("stop", stop)) for h in HORIZONS}
    weights = {f"weight_{h}": wt.severity(F.col(f"target_w{h}")) for h in HORIZONS}
    narrow = rows.withColumns({**roles, **weights}).select("region_id", "week_idx", "part", *roles, *weights)
    return frame.join(narrow, ["region_id", "week_idx"]), cols


def _roles(*names):
    return [[f"{n}_{h}" for h in HORIZONS] for n in names]


def horizon_model(spark, d):
    """(model, rows): five horizons fitted side by side."""
    rows, cols = boosted_split(spark, d)
    return bo.boost(rows, cols, *_roles("fit", "stop", "weight")), rows


@query("ml_gbt_horizon", "horizon:i trees:i mae baseline_mae")
def ml_gbt_horizon(spark, d):
    """Per horizon a weighted fit, stopped on rows that it doesn't see; the errors of the fit and of persistence
    are those of the calendar holdout."""
    model, rows = horizon_model(spark, d)
    truth = F.array(*[F.col(t).cast("double") for t in lg.TARGETS])
    out = bo.predict(model, rows.filter("part = 'val'").withColumn("truth", truth).withColumn("now", F.array_repeat(F.col("score").cast("double"), 5)), ["truth", "now"])
    long = no.long_predictions(out, HORIZONS).withColumn("now", F.col("now")[F.col("horizon") - 1])
    trees = F.array(*[F.lit(len(t)) for t in model.trees])
    return long.groupBy("horizon").agg(F.avg(mt.error()).alias("mae"), F.avg(F.abs(F.col("now") - F.col("truth"))).alias("baseline_mae")) \
        .withColumn("trees", trees[F.col("horizon") - 1])


@query("ml_gbt_shared", "horizon:i mae n:i")
def ml_gbt_shared(spark, d):
    """One weighted fit with the horizon as a feature, stopped as the single ones."""
    rows, cols = boosted_split(spark, d)
    each = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{n}_{h}").alias(n) for n in ("fit", "stop", "weight")],
                              F.col(f"target_w{h}").cast("double").alias("truth")) for h in HORIZONS])
    long = rows.select("part", *cols, F.explode(each).alias("t")).select("part", *cols, "t.*")
    model = bo.boost(long, [*cols, "horizon"], ["fit"], ["stop"], ["weight"])
    out = bo.predict(model, long.filter("part = 'val' AND truth IS NOT NULL").withColumnRenamed("horizon", "h").withColumn("horizon", F.col("h")), ["h", "truth"])
    return out.groupBy(F.col("h").alias("horizon")).agg(F.avg(F.abs(F.col("pred")[0] - F.col("truth"))).alias("mae"), F.count("*").alias("n"))


FOLDS = (1, 2, 3)


def oof(spark, d):
    """(out-of-fold rows, model, features): each fold and horizon is a target, all fitted side by side.

    A fold's fit stops on the newest fifth of the days it may see.
    """
    rows, cols = lag_frame(spark, d)
    parts = sp.purged_folds(mt.long_targets(rows.select("region_id", "week_idx", "ord", "month", *lg.TARGETS)), 4, 91)
    cuts = parts.filter("part = 'train'").groupBy("fold").agg(F.percentile_approx("ord", 0.8, 10000).alias("cut"))
    seen = parts.join(cuts, "fold", "left").withColumn("role", F.when(F.col("part") == "val", "val").when(F.col("ord") > F.col("cut"), "stop").otherwise("fit"))
    cell = lambda role, f, h: F.max(F.when((F.col("role") == role) & (F.col("fold") == f) & (F.col("horizon") == h), F.col("truth")))
    wide = seen.groupBy("region_id", "week_idx").agg(*[cell(r, f, h).alias(f"{r}_{f}_{h}") for r in ("fit", "stop", "val") for f in FOLDS for h in HORIZONS])
    rows = rows.join(ml.store(wide, "fold-roles"), ["region_id", "week_idx"], "left")
    names = [[f"{r}_{f}_{h}" for f in FOLDS for h in HORIZONS] for r in ("fit", "stop", "val")]
    model = bo.boost(rows, cols, names[0], names[1])
    out = bo.predict(model, rows.withColumn("truth", F.array(*[F.col(c).cast("double") for c in names[2]])), ["region_id", "week_idx", "truth"])
    n = len(HORIZONS)
    long = no.long_predictions(out, range(len(FOLDS) * n)).withColumns({"fold": F.expr(f"1 + horizon div {n}"), "horizon": F.expr(f"1 + horizon % {n}")})
    return ml.store(long, "oof"), model, rows


@query("ml_fold_oof", "fold:i horizon:i n:i mae")
def ml_fold_oof(spark, d):
    """Each row scored by a fit that hasn't seen its time."""
    return oof(spark, d)[0].groupBy("fold", "horizon").agg(F.count("*").alias("n"), F.avg(mt.error()).alias("mae"))


@query("ml_fold_predict", "region_id:s horizon:i pred")
def ml_fold_predict(spark, d):
    """Newest week of each region, predicted by the mean of the fold models of each horizon."""
    _, model, rows = oof(spark, d)
    out = bo.predict(model, lg.last_week(rows), ["region_id"]).select("region_id", F.posexplode("pred").alias("k", "p"))
    return out.groupBy("region_id", F.expr(f"1 + k % {len(HORIZONS)}").alias("horizon")).agg(F.avg("p").alias("pred"))


@query("ml_stratified", "region_id:s horizon:i pred")
def ml_stratified(spark, d):
    """Short-gap and long-gap fits for each horizon, from one scan, blended by each region's gap."""
    g = gaps.gap_weeks(gapped_train(spark, d), test(spark, d))
    strata = g.select("region_id", gaps.stratum(F.col("gap_weeks")).alias("stratum"))
    # features, targets and newest week all end where the region's history ends
    weeks = ml.store(wk.weekly_blocks(gapped_train(spark, d), keep=["score"]), "gapped-weeks")
    rows = sp.by_stratum(feature_rows(spark, d, weeks), strata).withColumn("g", (F.col("stratum") == "long").cast("int"))
    last = ml.store(lg.last_week(lg.with_score_history(weeks).select("region_id", "week_idx", *FEATURES)), "ends")
    sums = no.moments(rows, FEATURES, lg.TARGETS, "g")
    preds = {}
    for k, name in enumerate(("short", "long")):
        fit = {0: no.ridge(sums[k], 1.0)} if k in sums else {}
        out = no.predict(last, FEATURES, fit, keep=["region_id"])
        preds[name] = out.select("region_id", F.posexplode("pred").alias("h", "pred")).select("region_id", (F.col("h") + 1).alias("horizon"), "pred")
    return bl.blend_strata(preds["short"], preds["long"], g)


@query("ml_av_rows", "region_id:s week_idx:i p weight auc")
def ml_av_rows(spark, d):
    """How test-like each week's weather is, by the weather of its season."""
    w = weekly(spark, d)
    rows = lg.lag_matrix(w)
    cols = sp.lag0_weather_columns(rows.columns)
    rows = rows.select("region_id", "week_idx", *cols).join(w.select("region_id", "week_idx", "woy"), ["region_id", "week_idx"])
    rows = ml.store(sp.with_woy_distance(rows, meta(spark, d)).withColumn("label", (F.col("woy_dist") <= 6).cast("int")), "av")
    out, auc = ml.shift_classifier(rows, cols, "label", ["region_id", "week_idx"])
    return out.withColumn("auc", F.lit(auc))


STATS = [f"{c}_{s}" for c in CHANNELS for s in ("mean", "std", "q25", "q75")]


@query("ml_av_region_stats", "region_id:s " + " ".join(STATS), "SELECT region_id, " + ", ".join(
    f"avg({c}) {c}_mean, coalesce(stddev_samp({c}), 0) {c}_std, quantile_cont({c}, 0.25) {c}_q25, quantile_cont({c}, 0.75) {c}_q75" for c in CHANNELS)
       + " FROM train GROUP BY 1")
def ml_av_region_stats(spark, d):
    return ml.region_weather(train(spark, d))


@query("ml_av_regions", "region_id:s p weight auc")
def ml_av_regions(spark, d):
    """Train against test regions by their weather statistics; weights of the train regions."""
    a = ml.region_weather(train(spark, d)).withColumn("label", F.lit(0))
    b = ml.region_weather(test(spark, d)).withColumn("label", F.lit(1))
    rows = ml.store(a.unionByName(b), "av-regions")
    out, auc = ml.shift_classifier(rows, STATS, "label", ["region_id", "label"], holdout=False)
    return wt.with_unit_mean(out.filter("label = 0"), "weight").withColumn("auc", F.lit(auc))


PROFILE_SQL = """SELECT region_id, avg(CAST(score = 0 AS INT)) zero_rate, avg(score) mean_score, coalesce(stddev_samp(score), 0) std_score,
  max(score) max_score, quantile_cont(score, 0.9) p90_score FROM wk GROUP BY 1"""


@query("ml_kmeans_profile", "region_id:s " + " ".join(ml.PROFILE), PROFILE_SQL)
def ml_kmeans_profile(spark, d):
    return ml.score_profile(weekly(spark, d))


@query("ml_kmeans", "region_id:s region_cluster_id:i cluster_score_mean cluster_zero_rate")
def ml_kmeans(spark, d):
    profile = ml.store(ml.score_profile(weekly(spark, d)), "profile")
    return ml.join_clusters(profile.select("region_id"), ml.region_clusters(profile))


CLASSES = f"SELECT p.*, CAST(floor(mean_score*4) AS BIGINT) AS region_cluster_id FROM ({PROFILE_SQL}) p"


def classes(spark, d):
    """Deterministic classes standing in for a clustering."""
    return ml.score_profile(weekly(spark, d)).withColumn("region_cluster_id", F.floor(F.col("mean_score") * 4))


@query("ml_cluster_stats", "region_id:s region_cluster_id:i cluster_score_mean cluster_zero_rate", f"""
SELECT region_id, region_cluster_id, avg(mean_score) OVER c cluster_score_mean, avg(zero_rate) OVER c cluster_zero_rate
FROM ({CLASSES}) WINDOW c AS (PARTITION BY region_cluster_id)""")
def ml_cluster_stats(spark, d):
    return ml.with_cluster_stats(classes(spark, d))


@query("ml_archetype", "region_cluster_id:i n_regions:i label:s", f"""
SELECT region_cluster_id, n_regions, CASE WHEN z > 0.95 AND x <= 2 THEN 'quiet' WHEN m > 1.5 THEN 'high-severity' WHEN z > 0.85 THEN 'mostly-quiet'
  WHEN s > 0.9 THEN 'volatile' ELSE 'moderate' END AS label FROM (SELECT region_cluster_id, count(*) n_regions, avg(zero_rate) z, avg(mean_score) m,
  avg(std_score) s, avg(max_score) x FROM ({CLASSES}) GROUP BY 1)""")
def ml_archetype(spark, d):
    return ml.cluster_summary(classes(spark, d)).withColumn("label", ml.archetype())


@query("ml_pca2", "region_id:s pc1 pc2 share1 share2")
def ml_pca2(spark, d):
    return ml.profile_plane(ml.store(ml.score_profile(weekly(spark, d)), "profile"))


@query("ml_iso_global", "fold:i mae_before mae_after n:i")
def ml_iso_global(spark, d):
    scored = oof(spark, d)[0].withColumn("raw", F.col("pred"))
    out = ml.calibrate_global(scored)
    return out.groupBy("fold").agg(F.avg(F.abs(F.col("raw") - F.col("truth"))).alias("mae_before"),
                                   F.avg(mt.error()).alias("mae_after"), F.count("*").alias("n"))


def member_rows(spark, d):
    """Member c with its cluster, written once."""
    return ml.store(aligned(spark, d).withColumn("pred", F.col("p_c").cast("double")).select(
        "region_id", "week_idx", "horizon", "pred", "truth", "cluster_id"), "member")


def monotone_sql(fit, by, x="pred", y="truth"):
    """Points (`by`, x, v) of the monotone fit of table `fit`: the greatest over earlier starts of the least mean up to a later end."""
    keys, same = ", ".join(by), " AND ".join(f"a.{c} = b.{c}" for c in by)
    own = f"PARTITION BY {keys} ORDER BY p"
    return f"""(WITH pt AS (SELECT {keys}, round({x} * 10000) p, avg({x}) x, sum({y}) s, count(*) w FROM {fit} GROUP BY {keys}, p),
  c AS (SELECT *, row_number() OVER ({own}) i, sum(s) OVER ({own}) cs, sum(w) OVER ({own}) cw FROM pt),
  m AS (SELECT {", ".join(f"a.{c}" for c in by)}, a.i j, b.i i, b.x x,
    min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY {", ".join(f"a.{c}" for c in by)}, a.i ORDER BY b.i DESC) v
    FROM c a JOIN c b ON {same} AND a.i <= b.i)
  SELECT {keys}, i, x, max(v) v FROM m GROUP BY {keys}, i, x)"""


def mapped_sql(rows, points, by, x="pred"):
    """Rows with `out`: x between the neighbouring points of its group, null where the group has none."""
    same = lambda t: " AND ".join(f"{t}.{c} = r.{c}" for c in by)
    return f"""(SELECT r.*, least(greatest(CASE WHEN lo.x IS NULL THEN hi.v WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.v
    ELSE lo.v + (hi.v - lo.v) * (r.{x} - lo.x) / (hi.x - lo.x) END, 0), 5) AS out
  FROM {rows} r ASOF LEFT JOIN {points} lo ON {same("lo")} AND lo.x <= r.{x} ASOF LEFT JOIN {points} hi ON {same("hi")} AND hi.x >= r.{x})"""


MEMBER_SQL = "m AS (SELECT region_id, week_idx, horizon, p_c AS pred, truth, cluster_id FROM al), early AS (SELECT * FROM m WHERE week_idx < 250), late AS (SELECT * FROM m WHERE week_idx >= 250)"


@query("ml_iso_horizon", "horizon:i mae_before mae_after accepted:i", f"""
WITH {MEMBER_SQL}, pts AS {monotone_sql("early", ["horizon"])},
e AS (SELECT horizon, avg(abs(pred - truth)) b, avg(abs(out - truth)) a FROM {mapped_sql("late", "pts", ["horizon"])} GROUP BY 1),
ok AS (SELECT CASE WHEN avg(b) - avg(a) >= 1e-4 THEN 1 ELSE 0 END AS yes FROM e)
SELECT horizon, b AS mae_before, CASE WHEN yes = 1 THEN a ELSE b END AS mae_after, yes AS accepted FROM e CROSS JOIN ok""")
def ml_iso_horizon(spark, d):
    """Calibrated on the earlier weeks, accepted only if the later weeks improve."""
    m = member_rows(spark, d)
    early, late = m.filter("week_idx < 250"), m.filter("week_idx >= 250")
    objective = lambda r: mt.macro_mae(r).first()["macro_mae"]
    out, accepted = ml.accept_if_better(late, ml.calibrate_horizons(early, late), objective)
    before = late.groupBy("horizon").agg(F.avg(mt.error()).alias("mae_before"))
    after = out.groupBy("horizon").agg(F.avg(mt.error()).alias("mae_after"))
    return before.join(after, "horizon").withColumn("accepted", F.lit(int(accepted)))


@query("ml_iso_cluster", "cluster_id:i horizon:i n:i mae", f"""
WITH {MEMBER_SQL}, known AS (SELECT * FROM early WHERE cluster_id >= 0), pts AS {monotone_sql("known", ["cluster_id", "horizon"])},
whole AS {monotone_sql("known", ["horizon"])}, one AS (SELECT * RENAME (out AS own) FROM {mapped_sql("late", "pts", ["cluster_id", "horizon"])}),
two AS {mapped_sql("one", "whole", ["horizon"])}
SELECT cluster_id, horizon, count(*) n, avg(abs(coalesce(own, out) - truth)) mae FROM two GROUP BY 1, 2""")
def ml_iso_cluster(spark, d):
    """Clusters seen in the earlier weeks get their own maps."""
    m = member_rows(spark, d)
    out = ml.calibrate_clusters(m.filter("week_idx < 250 AND cluster_id >= 0"), m.filter("week_idx >= 250"))
    return out.groupBy("cluster_id", "horizon").agg(F.count("*").alias("n"), F.avg(mt.error()).alias("mae"))


@query("ml_iso_spei", PREDS + " spei")
def ml_iso_spei(spark, d):
    a, b = (ix.with_balance(x) for x in (weekly(spark, d), weekly_test(spark, d)))
    rows = lg.lead_targets(ix.spei_train(a)).select("region_id", "week_idx", "spei", *lg.TARGETS)
    return ml.spei_map(rows, ix.spei_test(a, b).select("region_id", "spei"))


DECOMP_WEEKS = 260
DECOMP_SIDE = [*lg.SCORE_HISTORY, "month_sin", "month_cos", "doy_sin", "doy_cos"]


def decomp_blocks(spark, d):
    """Blocks of the fifteen channels and the side columns, normalised, with a hashed 90/10 split of the anchors.

    Mean and deviation of a column are those of the weeks up to a region's last anchor of the fit.
    """
    w = lg.with_score_history(wk.weekly_channels(imputed(spark, d)))
    w = ml.store(w.select("region_id", "week_idx", "month", "doy", "score", *CH15, *lg.SCORE_HISTORY), "channels")
    w = w.withColumns(dict(zip(("month_sin", "month_cos", "doy_sin", "doy_cos"), (*cyclic(F.col("month"), 12), *cyclic(F.col("doy"), 365)))))
    rows = ml.store(sp.random_split(lg.lead_targets(w), ["region_id", "week_idx"]).select("region_id", "week_idx", "part", *lg.TARGETS), "anchors")
    last = rows.filter("part = 'train'").groupBy("region_id").agg(F.max("week_idx").alias("_last"))
    cols = [*CH15, *DECOMP_SIDE]
    norm = w.join(last, "region_id").filter("week_idx <= _last").agg(
        *[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols]).first()
    scale = {c: (norm[f"{c}_m"] or 0.0, norm[f"{c}_s"] if (norm[f"{c}_s"] or 0.0) >= 1e-6 else 1.0) for c in cols}
    w = w.select("region_id", "week_idx", *[((F.col(c) - m) / s).alias(c) for c, (m, s) in scale.items()])
    rows = rows.join(w.select("region_id", "week_idx", *DECOMP_SIDE), ["region_id", "week_idx"])
    return sf.blocks(w, rows, CH15, DECOMP_SIDE, lg.TARGETS, DECOMP_WEEKS)


def decomp_fit(spark, d):
    """(blocks, shape, weights) of the members with three kernels, fitted together."""
    shape = sf.Shape(len(CH15), DECOMP_WEEKS, KERNELS, len(DECOMP_SIDE), len(HORIZONS))
    rows, weights, _ = sf.fit(decomp_blocks(spark, d), shape)
    return rows, shape, weights


@query("ml_decomp_linear", "part:s " + " ".join(f"mae_w{h}" for h in HORIZONS) + " macro_mae n:i")
def ml_decomp_linear(spark, d):
    """260 weeks of fifteen channels split into trend and season with three kernels, whose members are averaged."""
    rows, shape, weights = decomp_fit(spark, d)
    out = sf.predicted(rows, shape, weights).select("region_id", "week_idx", "part", *[
        F.least(F.greatest(F.col("pred")[h - 1], F.lit(0.0)), F.lit(5.0)).alias(f"pred_week{h}") for h in HORIZONS])
    truth = rows.select("region_id", F.explode(F.arrays_zip("at", F.expr(
        f"transform(sequence(0, size(at) - 1), i -> slice(truth, i * {len(HORIZONS)} + 1, {len(HORIZONS)}))").alias("y"))).alias("t"))
    out = out.join(truth.select("region_id", F.col("t.at").alias("week_idx"), F.col("t.y").alias("y")), ["region_id", "week_idx"])
    return out.groupBy("part").agg(*[F.avg(F.abs(F.col(f"pred_week{h}") - F.col("y")[h - 1])).alias(f"mae_w{h}") for h in HORIZONS],
                                   F.count("*").alias("n")) \
        .withColumn("macro_mae", sum((F.col(f"mae_w{h}") for h in HORIZONS[1:]), F.col("mae_w1")) / 5)


@query("ml_importance", "feature:s importance rank:i")
def ml_importance(spark, d):
    """The columns with the greatest share of the gain, the mean over the horizons."""
    model, _ = horizon_model(spark, d)
    ranked = sorted(model.importance().items(), key=lambda x: (-x[1], x[0]))[:25]
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")


HOLDOUTS = {"season": sp.season_holdout, "deficit": sp.hot_holdout}


def subset_rows(spark, d):
    """(rows, columns): both holdouts' pool and held-out rows, with all columns of the frame and scalars of the own pool."""
    w = cl.week_spi(weekly(spark, d))
    rows = ml.store(lg.targets_by_ordinal(ix.shift_aware_frame(w, ix.region_base(w))), "subset-frame")
    cols = [c for c in ix.feature_columns(rows) if c != "spi"]
    last, parts = last_test_week(spark, d), []
    for k, split in enumerate(HOLDOUTS.values()):
        own = split(rows, last).select("region_id", "week_idx", "score", "part", "spi", *cols, *lg.TARGETS)
        parts.append(cl.region_scalars(own, own.filter("part = 'train'")).withColumn("holdout", F.lit(k)))
    return ml.store(reduce(lambda a, b: a.unionByName(b), parts).filter("part <> 'purged'"), "subsets"), cols


SUBSET = "n_columns:i mae edge bias"


@query("ml_feature_subsets", f"holdout:s subset:s {SUBSET} true_mean")
def ml_feature_subsets(spark, d):
    """Edge over the region mean and bias of four column sets on two holdouts, a fit for each horizon.

    One scan adds up the products of all columns; each set is solved from its part of the sums.
    """
    rows, frame_cols = subset_rows(spark, d)
    every = [*frame_cols, "spi", *cl.SCALARS]
    sets = {name: [every.index(c) for c in [*cols, *cl.SCALARS]] for name, cols in ml.feature_subsets(frame_cols).items()}
    sums = no.moments(rows.filter("part = 'train'"), every, lg.TARGETS, "holdout")
    fits = {}
    for k, m in sums.items():
        own = [no.ridge(m, 10.0, pick) for pick in sets.values()]
        fits[k] = tuple(np.concatenate(x) for x in zip(*own))
    val = rows.filter("part = 'val'").withColumn("truth", F.array(*[F.col(t).cast("double") for t in lg.TARGETS]))
    out = no.predict(val, every, fits, "holdout", ["holdout", "truth", "region_score_mean"])
    n = len(HORIZONS)
    names = F.array(*[F.struct(F.lit(name).alias("subset"), F.lit(len(cols)).alias("n_columns"), F.lit(i).alias("i")) for i, (name, cols) in enumerate(sets.items())])
    out = out.withColumn("s", F.explode(names)).select("holdout", "s.subset", "s.n_columns", "truth", F.expr(f"slice(pred, 1 + s.i * {n}, {n})").alias("pred"),
                                                       F.array_repeat("region_score_mean", n).alias("level"))
    long = no.long_predictions(out.select("holdout", "subset", "n_columns", "truth", "pred", "level"), HORIZONS)
    long = long.withColumn("level", F.col("level")[F.col("horizon") - 1])
    error, base = F.avg(mt.error()), F.avg(F.abs(F.col("level") - F.col("truth")))
    by = long.groupBy("holdout", "subset", "n_columns", "horizon").agg(error.alias("e"), base.alias("b"), F.sum(F.col("pred") - F.col("truth")).alias("d"),
                                                                      F.sum("truth").alias("t"), F.count("*").alias("n"))
    names = F.array(*[F.lit(h) for h in HOLDOUTS])
    return by.groupBy("holdout", "subset", "n_columns").agg(
        F.avg("e").alias("mae"), (F.avg("b") - F.avg("e")).alias("edge"), (F.sum("d") / F.sum("n")).alias("bias"),
        (F.sum("t") / F.sum("n")).alias("true_mean")).withColumn("holdout", names[F.col("holdout")])


SUM_COLS = ["tmp_mean", "prec_sum", "spi_8", "humidity_ranom4", "doy_sin"]


@query("ml_normal_means", "horizon:i a:s b:s value:r", f"""
WITH x AS (SELECT f.region_id, f.week_idx, {", ".join(f"coalesce(f.{c}, 0) {c}" for c in SUM_COLS[2:])}, coalesce(w.tmp_mean, 0) tmp_mean, coalesce(w.prec_sum, 0) prec_sum,
  a.target_w1, a.target_w3 FROM ({FRAME_SQL}) f JOIN wk w USING (region_id, week_idx) JOIN anc a USING (region_id, week_idx)),
l AS (SELECT *, 1 AS horizon, target_w1 AS y FROM x UNION ALL SELECT *, 3, target_w3 FROM x)
SELECT horizon, a, b, avg(p) AS value FROM (SELECT horizon, unnest([{", ".join(f"'{a}'" for i, a in enumerate(SUM_COLS) for b in [*SUM_COLS[i:], "y"])}]) a,
  unnest([{", ".join(f"'{b}'" for i, a in enumerate(SUM_COLS) for b in [*SUM_COLS[i:], "y"])}]) b,
  unnest([{", ".join(f"{a} * {b}" for i, a in enumerate(SUM_COLS) for b in [*SUM_COLS[i:], "y"])}]) p FROM l WHERE y IS NOT NULL) GROUP BY 1, 2, 3""")
def ml_normal_means(spark, d):
    """Means of the products that the fits of `ml_feature_subsets` are solved from, for some columns and horizons."""
    w = weekly(spark, d)
    rows = lg.lead_targets(ix.shift_aware_frame(w, ix.region_base(w)))
    sums = no.moments(rows, SUM_COLS, ["target_w1", "target_w3"])[0]
    names = [*SUM_COLS, "1", "y"]
    out = [(h, names[i], names[j], float(m[i, j] / m[-2, -2])) for h, m in zip((1, 3), sums) for i in range(len(SUM_COLS)) for j in range(i, len(names)) if names[j] != "1"]
    return spark.createDataFrame(out, "horizon int, a string, b string, value double")
