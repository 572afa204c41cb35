"""The tables most queries start from."""
from pyspark.sql import functions as F

from panelcast.operators import lags, metrics, weekly as wk
from panelcast.sources.files import store
from panelcast.sources.panel import gapped_train_part, test_part, train_part


def train(spark, d):
    return train_part(spark, d)


def test(spark, d):
    return test_part(spark, d)


def stored_train(spark, d):
    """Train part written once, for queries that pass over it several times."""
    return store(train(spark, d), "train")


def gapped_train(spark, d):
    return gapped_train_part(train_part(spark, d))


def weekly(spark, d):
    """Weekly table of the train part. The panel is scored on every seventh day, so its
    seven-day blocks are the windows that end at the scored days."""
    return wk.weekly_blocks(train(spark, d), keep=["score"])


def weekly_test(spark, d):
    return wk.weekly_blocks(test(spark, d))


def anchors(spark, d):
    """Weeks with enough history and five future scores."""
    return lags.lead_targets(weekly(spark, d))


def clusters(spark, d):
    """Deterministic region classes by mean score."""
    w = weekly(spark, d).groupBy("region_id").agg(F.avg("score").alias("score_mean"))
    return w.withColumn(
        "region_cluster_id", F.floor(F.col("score_mean") * 2))


MEMBERS = ["a", "b", "c"]


def aligned(spark, d, with_clusters=True):
    """Anchors x horizons with three deterministic members: the current score, the region mean,
    and the mean of the score and the region's month mean."""
    w = weekly(spark, d)
    rows = metrics.long_targets(lags.lead_targets(w).select(
        "region_id", "week_idx", "ord", "month", "score", *lags.TARGETS))
    rows = (rows.join(w.groupBy("region_id").agg(F.avg("score").alias("p_b")), "region_id")
            .join(w.groupBy("region_id", "month").agg(F.avg("score").alias("_m")), ["region_id", "month"]))
    rows = rows.withColumns({"p_a": F.col("score").cast("double"),
                             "p_c": 0.5 * F.col("score") + 0.5 * F.col("_m")}).drop("_m")
    if with_clusters:
        rows = rows.join(clusters(spark, d).drop("score_mean"), "region_id", "left").withColumn(
            "cluster_id", F.coalesce("region_cluster_id", F.lit(-1)).cast("int")).drop("region_cluster_id")
    return rows


def members(spark, d):
    """The same as a long table (member, region_id, week_idx, horizon, pred, truth)."""
    rows = aligned(spark, d, False)
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"p_{m}").alias("p")) for m in MEMBERS])
    return rows.withColumn("x", F.explode(each)).select(
        F.col("x.m").alias("member"), "region_id", "week_idx", "horizon", F.col("x.p").alias("pred"), "truth")
