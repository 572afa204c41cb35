"""Model fits with MLlib on feature tables, and what is read off them.

Feature tables that are read by several fits are written once (`store`). Loops run over
horizons, folds or scales, never over rows; each pass is a distributed fit.
"""
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, HORIZONS, KEY
from panelcast.functions.scalars import clip
from panelcast.operators import monotone as mo
from panelcast.operators.cleaning import attach
from panelcast.operators.splits import hashed_share
from panelcast.operators.weights import density_ratio, with_unit_mean
from panelcast.sources.files import store


#: Trees of every boosted fit. With steps of 0.3 and depth 3 the holdout error levels off before.
TREES = 20


def assemble(df, cols, out="features"):
    filled = df.na.fill(0.0, cols)
    return VectorAssembler(inputCols=cols, outputCol=out).transform(filled)


def ridge(df, cols, label, alpha, standardize=False):
    """Ridge with the penalty of sum-of-squares implementations.

    MLlib divides the loss by n and scales by the label deviation, hence alpha * sd / n.
    """
    rows = df.filter(F.col(label).isNotNull())
    n, sd = rows.agg(F.count("*"), F.stddev_pop(label)).first()
    fit = LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred", solver="normal",
                           regParam=alpha * (sd or 0.0) / max(n, 1), elasticNetParam=0.0, standardization=standardize)
    return fit.fit(assemble(rows, cols))


def coefficients(spark, model, cols):
    rows = [(c, float(v)) for c, v in zip(cols, model.coefficients)] + [("(intercept)", float(model.intercept))]
    return spark.createDataFrame(rows, "term string, value double")


def predict(model, df, cols, out="pred"):
    """Clipped predictions with the inputs' own columns kept."""
    scored = model.transform(assemble(df, cols)).drop("features")
    return scored.withColumn("pred", clip(F.col("pred"), 0.0, 5.0)).withColumnRenamed("pred", out)


def proxy_columns(columns, w, channels=CHANNELS):
    """Inputs of the proxy of window w: anomalies that do not carry the region's level."""
    wanted = [f"{c}_ranom{w}" for c in channels] + [f"{n}{w}" for n in ("spi_", "prec_deficit", "heat_dd", "aridity", "vpd_roll", "dtr_roll")]
    wanted += [c for c in columns if c.endswith(("_anom_sl", "_anom_z"))]
    wanted += ["doy_sin", "doy_cos", "month_sin", "month_cos"]
    return [c for c in dict.fromkeys(wanted) if c in columns]


def proxy_scales(pool, rows, scales=(4, 8, 12)):
    """Standardised ridge per window on the pool's next-week score; scores, mean, differences."""
    out = rows
    for w in scales:
        cols = proxy_columns(pool.columns, w)
        out = predict(ridge(pool, cols, "target_w1", 1.0, True), out, cols, f"proxy_p{w}")
    p = [F.col(f"proxy_p{w}") for w in scales]
    a, b, c = scales
    return out.withColumns({"proxy_main": reduce(lambda x, y: x + y, p) / len(p), f"proxy_{a}_{c}": p[0] - p[2],
                            f"proxy_{b}_{c}": p[1] - p[2], f"proxy_{a}_{b}": p[0] - p[1]})


def linear_horizons(train, rows, cols, alpha=10.0):
    """One standardised ridge per horizon; columns pred_week1..5."""
    for h in HORIZONS:
        rows = predict(ridge(train, cols, f"target_w{h}", alpha, True), rows, cols, f"pred_week{h}")
    return rows


def boosted(train, cols, label, weight=None, holdout=None, trees=TREES, depth=3, seed=42):
    """L1 boosted trees; with a holdout the number of trees with its lowest error is kept.

    Boosting is sequential and seeded, so refitting with fewer trees gives the same first trees.
    """
    rows = assemble(train.filter(F.col(label).isNotNull()), cols)
    def fit(k):
        g = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="pred", lossType="absolute",
                         maxIter=k, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed)
        return (g.setWeightCol(weight) if weight else g).fit(rows)
    model = fit(trees)
    if holdout is None:
        return model, trees
    held = holdout.filter(F.col(label).isNotNull())
    if held.isEmpty():
        return model, trees
    errors = model.evaluateEachIteration(assemble(held, cols), "absolute")
    best = min(range(len(errors)), key=errors.__getitem__) + 1
    return (model if best == trees else fit(best)), best


def importance(models, cols, top=25):
    """Mean feature importance of several fits, ranked."""
    mean = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(cols))]
    return sorted(zip(cols, mean), key=lambda x: (-x[1], x[0]))[:top]


def out_of_fold(rows, cols, label, fit, folds, minimum=(20, 10)):
    """Fit per fold, predict the fold's validation rows; returns (rows with pred, models).

    `rows` has `fold` and `part`; folds with too little data are skipped.
    """
    sizes = {(r.fold, r.part): r.n for r in rows.groupBy("fold", "part").agg(F.count("*").alias("n")).collect()}
    scored, models = [], []
    for f in folds:
        if sizes.get((f, "train"), 0) < minimum[0] or sizes.get((f, "val"), 0) < minimum[1]:
            continue
        model = fit(rows.filter((F.col("fold") == f) & (F.col("part") == "train")), cols, label)
        models.append(model)
        scored.append(predict(model, rows.filter((F.col("fold") == f) & (F.col("part") == "val")), cols))
    return (reduce(lambda a, b: a.unionByName(b), scored) if scored else None), models


def early_late(rows, time="ord", share=0.8):
    """Rows up to the day that `share` of them reach, and the later ones: the split where no fold has enough rows."""
    cut = rows.agg(F.percentile_approx(time, share, 10000)).first()[0]
    return (rows, rows.limit(0)) if cut is None else (rows.filter(F.col(time) <= cut), rows.filter(F.col(time) > cut))


def out_of_fold_by_horizon(rows, cols, label, fit, folds, time="ord", minimum=(20, 10)):
    """`out_of_fold` for each horizon by itself; returns (scored rows, models by horizon).

    A horizon without a fold of enough rows is fitted on its early rows and scored on its late ones (fold 0).
    """
    scored, models = [], {}
    for h in HORIZONS:
        own = rows.filter(F.col("horizon") == h)
        out, fits = out_of_fold(own, cols, label, fit, folds, minimum)
        if not fits:
            base = own.drop("fold", "part").distinct()
            early, late = early_late(base, time)
            if early.isEmpty():
                models[h] = []
                continue
            fits = [fit(early, cols, label)]
            out = predict(fits[0], late, cols).withColumns({"fold": F.lit(0), "part": F.lit("val")}).select(*rows.columns, "pred")
        scored.append(out)
        models[h] = fits
    empty = rows.limit(0).withColumn("pred", F.lit(0.0))
    return reduce(lambda a, b: a.unionByName(b), scored, empty), models


def mean_prediction(models, rows, cols, fallback):
    """Mean of several models' predictions, or the fallback when there is none."""
    if not models:
        return rows.withColumn("pred", F.lit(float(fallback)))
    vec = assemble(rows, cols)
    for i, m in enumerate(models):
        vec = m.transform(vec).withColumnRenamed("pred", f"_p{i}")
    total = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(models))])
    return vec.withColumn("pred", clip(total / len(models), 0.0, 5.0)).drop("features", *[f"_p{i}" for i in range(len(models))])


def shift_classifier(rows, cols, label, keys, max_rows=300_000, depth=3, trees=TREES, seed=42, holdout=True):
    """Classifier of test-likeness, its AUC on a hashed fifth, and odds weights of all rows.

    The classifier is fitted on a hashed sample of about `max_rows` labelled rows; every row is scored. With
    holdout=False it is fitted on all of the sample, and the AUC is that of the fitted rows.
    """
    n = rows.count()
    keep = min(1.0, max_rows / max(n, 1))
    share = hashed_share(keys, seed, 1_000_000)
    vec = assemble(rows, cols).withColumn("_l", F.col(label).cast("double"))
    sample = vec.filter(share < keep * 1_000_000)
    inner = hashed_share(keys, seed + 1, 5)
    model = GBTClassifier(featuresCol="features", labelCol="_l", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed).fit(
        sample.filter(inner != 0) if holdout else sample)
    auc = BinaryClassificationEvaluator(labelCol="_l", rawPredictionCol="rawPrediction").evaluate(
        model.transform(sample.filter(inner == 0) if holdout else sample))
    scored = model.transform(vec).withColumn("p", vector_to_array("probability")[1])
    out = scored.drop("features", "rawPrediction", "probability", "prediction", "_l")
    return with_unit_mean(out.withColumn("weight", density_ratio(F.col("p"))), "weight"), auc


def region_weather(daily, channels=CHANNELS, borders=None):
    """Mean, deviation and quartiles per region and channel; null counts as 0."""
    from panelcast.functions import ranks
    q = ranks.spread(ranks.exact_quantiles(daily, channels, [0.25, 0.75], by=[KEY], borders=borders),
                     {f"{c}_q{p}": (c, i) for c in channels for i, p in enumerate((25, 75))}, by=[KEY])
    one = daily.groupBy(KEY).agg(*[F.expr(f"avg({c}) AS {c}_mean") for c in channels],
                                 *[F.expr(f"stddev_samp({c}) AS {c}_std") for c in channels])
    return one.join(q, KEY, "left").na.fill(0.0)


PROFILE = ["zero_rate", "mean_score", "std_score", "max_score", "p90_score"]


def score_profile(scored):
    """Zero share, mean, deviation, maximum and 90th percentile of each region's score."""
    from panelcast.operators.climatology import score_stats
    return score_stats(scored, [KEY], {"zero_rate": "zero_rate", "mean_score": "mean", "std_score": "std0",
                                       "max_score": "max", "p90_score": "q90"}).withColumn("max_score", F.col("max_score").cast("double"))


def _scaled(profile, with_std=True):
    vec = VectorAssembler(inputCols=PROFILE, outputCol="_raw").transform(profile)
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=with_std).fit(vec).transform(vec)


def region_clusters(profile, k=8, seed=42):
    """KMeans on the standardised profile, with each cluster's mean score and zero share."""
    vec = _scaled(profile)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="region_cluster_id").fit(vec)
    out = model.transform(vec).drop("_raw", "features")
    return with_cluster_stats(out)


def with_cluster_stats(assigned):
    stats = assigned.groupBy("region_cluster_id").agg(F.avg("mean_score").alias("cluster_score_mean"),
                                                      F.avg("zero_rate").alias("cluster_zero_rate"))
    return assigned.join(stats, "region_cluster_id")


def join_clusters(rows, clusters):
    """Cluster columns for every row; an unseen region gets -1 and the table means."""
    table = clusters.select(KEY, "region_cluster_id", "cluster_score_mean", "cluster_zero_rate")
    means = clusters.agg(F.avg("cluster_score_mean").alias("m"), F.avg("cluster_zero_rate").alias("z"))
    out = attach(rows.join(table, KEY, "left"), means, "_c")
    return out.withColumns({"region_cluster_id": F.coalesce("region_cluster_id", F.lit(-1)),
                            "cluster_score_mean": F.coalesce("cluster_score_mean", F.col("_c.m")),
                            "cluster_zero_rate": F.coalesce("cluster_zero_rate", F.col("_c.z"))}).drop("_c")


def cluster_summary(assigned):
    return assigned.groupBy("region_cluster_id").agg(F.count("*").alias("n_regions"), *[F.avg(c).alias(c) for c in PROFILE])


def archetype():
    """Name of a cluster from its mean profile."""
    z, m = F.col("zero_rate"), F.col("mean_score")
    return (F.when((z > 0.95) & (F.col("max_score") <= 2), "quiet").when(m > 1.5, "high-severity")
            .when(z > 0.85, "mostly-quiet").when(F.col("std_score") > 0.9, "volatile").otherwise("moderate"))


def profile_plane(profile):
    """First two principal components of the standardised profile and their variance shares."""
    vec = _scaled(profile)
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(vec)
    xy = vector_to_array("_pc")
    out = model.transform(vec).select(KEY, xy[0].alias("pc1"), xy[1].alias("pc2"))
    a, b = (float(v) for v in model.explainedVariance)
    return out.withColumns({"share1": F.lit(a), "share2": F.lit(b)})


def calibrated(fit_rows, rows, by=(), x="pred", y="truth", out="pred", increasing=True):
    """`out`: x by a monotone map x -> y for each group of `by`, fitted on other rows, all groups in one pass.

    A group without fit rows takes the map of the groups one column less, at last x itself.
    """
    maps = [(list(by[k:]), mo.curves(mo.pools(fit_rows, by[k:], x, y, increasing), by[k:], increasing)) for k in range(max(1, len(by)))]
    return mo.mapped(rows, maps, x, out)


def calibrate_global(oof, minimum=50):
    """One map over all out-of-fold rows; unchanged rows when there are too few."""
    return oof if oof.limit(minimum).count() < minimum else calibrated(oof, oof)


def calibrate_horizons(fit_rows, rows):
    return calibrated(fit_rows, rows, ["horizon"])


def accept_if_better(before, after, objective, gain=1e-4):
    """The calibrated rows only when they lower the objective by at least `gain`."""
    a, b = objective(before), objective(after)
    return (after, True) if a - b >= gain else (before, False)


def calibrate_clusters(fit_rows, rows):
    """One map per (cluster, horizon); clusters without fit rows use the horizon's map."""
    return calibrated(fit_rows, rows, ["cluster_id", "horizon"])


def spei_map(train, rows):
    """Decreasing map from the drought index to each target; columns pred_week1..5.

    A missing index takes the mean index.
    """
    mean = train.agg(F.avg("spei")).scalar()
    train, rows = (df.withColumn("spei", F.coalesce("spei", mean)) for df in (train, rows))
    targets = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"target_w{h}").cast("double").alias("y")) for h in HORIZONS])
    long = train.select("spei", F.explode(targets).alias("t")).select("spei", F.col("t.h").alias("horizon"), F.col("t.y").alias("truth"))
    curves = mo.curves(mo.pools(long, ["horizon"], "spei", "truth", False), ["horizon"], False)
    for h in HORIZONS:
        rows = mo.mapped(rows, [([], {(): curves[h,]} if (h,) in curves else {})], "spei", f"pred_week{h}")
    return rows


TEMPERATURES = ("tmp", "tmp_max", "tmp_min", "tmp_range", "surf_tmp", "wb_tmp", "dp_tmp")


def feature_subsets(cols):
    """All columns, without temperatures, with only their deviations, and with the rain index."""
    def hot(c):
        return any(c == t or c.startswith(t + "_") for t in TEMPERATURES)
    cool = [c for c in cols if not hot(c)]
    return {"all": list(cols), "no_temp": cool, "no_temp_keep_std": [c for c in cols if not hot(c) or c.endswith("_std")],
            "no_temp_spi": [*cool, "spi"]}
