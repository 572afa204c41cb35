"""Invariants of panels, weekly tables, features and predictions, as violation counts."""
from pyspark.sql import functions as F


def panel_violations(weekly, weeks):
    """Regions without `weeks` rows, scores outside 0..5, missing scores, total rows."""
    per_region = weekly.groupBy("region_id").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("score") < 0) | (F.col("score") > 5)).alias("bad_score"),
        F.count_if(F.col("score").isNull()).alias("null_score"))
    return per_region.agg(
        F.count("*").alias("n_regions"), F.sum("n").alias("n_rows"),
        F.count_if(F.col("n") != weeks).alias("uneven_regions"),
        F.sum("bad_score").alias("bad_scores"), F.sum("null_score").alias("null_scores"))


def left_out_items(items, suppliers, inside):
    """Line items in all, those not `inside` the panel's days (a missing date is outside) and those without a supplier."""
    known = suppliers.select(F.col("s_suppkey").alias("l_suppkey")).distinct().withColumn("known", F.lit(True))
    counted = items.select("l_suppkey", F.coalesce(inside, F.lit(False)).alias("inside")).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("out"))
    return counted.join(known, "l_suppkey", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum("out"), F.lit(0)).alias("undated_items"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_items"))


def target_violations(anchors, expected_per_region, targets):
    per_region = anchors.groupBy("region_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(t).isNull()).alias(t) for t in targets])
    return per_region.agg(
        F.count_if(F.col("n") != expected_per_region).alias("uneven_anchors"),
        F.sum(sum((F.col(t) for t in targets[1:]), F.col(targets[0]))).alias("null_targets"))
