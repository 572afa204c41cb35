"""Scans, sinks, checks."""
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, HORIZONS
from panelcast.operators.checks import left_out_items, panel_violations, target_violations
from panelcast.operators.cleaning import attach
from panelcast.plans.base import query
from panelcast.plans.inputs import anchors, test, train, weekly
from panelcast.plans.prefix import _CH
from panelcast.sources import files
from panelcast.sources.panel import between_days, panel, table, training_history

PANEL_COLS = "region_id:s day_idx:i date:s " + " ".join(CHANNELS) + " score:i"
PRED_COLS = "region_id:s " + " ".join(f"pred_week{h}" for h in HORIZONS)


@query("src_panel", PANEL_COLS, f"SELECT region_id, day_idx, date, {_CH}, score FROM panel")
def src_panel(spark, d):
    return panel(spark, d)


@query("src_csv", "region_id:s date:s " + " ".join(CHANNELS) + " score:i",
       f"SELECT region_id, date, {_CH}, score FROM train")
def src_csv(spark, d):
    path = files.fresh(spark, "csv")
    files.write_panel_csv(train(spark, d).select("region_id", "date", *CHANNELS, "score"), path)
    return files.read_panel_csv(spark, path)


@query("src_cols", "region_id:s date:s score:i", "SELECT region_id, date, score FROM train")
def src_cols(spark, d):
    return train(spark, d).select("region_id", "date", "score")


@query("src_scored", "region_id:s date:s score:i",
       "SELECT region_id, date, score FROM train WHERE score IS NOT NULL")
def src_scored(spark, d):
    return files.scored_rows(train(spark, d)).select("region_id", "date", "score")


@query("src_region_sample", "region_id:s n_rows:i", """SELECT region_id, count(*) AS n_rows FROM panel WHERE region_id IN (
  SELECT region_id FROM (SELECT DISTINCT region_id FROM panel) ORDER BY md5(concat_ws('|', region_id, '42')), region_id LIMIT 5) GROUP BY 1""")
def src_region_sample(spark, d):
    return files.sample_regions(panel(spark, d), 5).groupBy("region_id").agg(F.count("*").alias("n_rows"))


@query("src_union_hist", "region_id:s day_idx:i phase:s tmp prec",
       "SELECT region_id, day_idx, 'train' AS phase, tmp, prec FROM train UNION ALL "
       "SELECT region_id, day_idx+2408, 'test', tmp, prec FROM test")
def src_union_hist(spark, d):
    return training_history(train(spark, d), test(spark, d))


def predictions(spark, d):
    """Deterministic forecast: half the region mean, half the last score, less with distance."""
    scored = train(spark, d).filter("score is not null")
    base = scored.groupBy("region_id").agg(F.avg("score").alias("m"), F.max_by("score", "day_idx").alias("l"))
    h = F.explode(F.sequence(F.lit(1), F.lit(5)))
    long = base.withColumn("horizon", h).withColumn(
        "pred", 0.5 * F.col("m") + 0.5 * F.col("l") - 0.1 * F.col("horizon"))
    return long.select("region_id", "horizon", "pred")


PRED_SQL = """SELECT region_id, {cols} FROM (
  SELECT region_id, avg(score) m, max_by(score, day_idx) l FROM train WHERE score IS NOT NULL GROUP BY 1)"""
_raw = {h: f"least(5, greatest(0, 0.5*m + 0.5*l - 0.1*{h}))" for h in HORIZONS}


@query("snk_pred", PRED_COLS, PRED_SQL.format(cols=", ".join(f"{_raw[h]} pred_week{h}" for h in HORIZONS)))
def snk_pred(spark, d):
    path = files.fresh(spark, "predictions")
    files.write_predictions(files.prediction_table(predictions(spark, d)), path)
    return files.read_predictions(spark, path)


@query("snk_pred_sample", PRED_COLS, f"""
SELECT n.region_id, {", ".join(f"round(coalesce(pred_week{h}, (SELECT avg(score) FROM train)), 4) AS pred_week{h}" for h in HORIZONS)}
FROM (SELECT 'R' || n_nationkey AS region_id FROM nation) n LEFT JOIN (
  SELECT * FROM ({PRED_SQL.format(cols=", ".join(f"{_raw[h]} pred_week{h}" for h in HORIZONS))})) USING (region_id)""")
def snk_pred_sample(spark, d):
    sample = table(spark, d, "nation").select(
        F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("region_id"))
    wide = files.prediction_table(predictions(spark, d))
    fallback = train(spark, d).agg(F.avg("score")).scalar()
    return files.predictions_for_sample(sample, wide, fallback)


@query("fallback_mean", "score_mean n:i", "SELECT avg(score) score_mean, count(score) n FROM train")
def fallback_mean(spark, d):
    return train(spark, d).agg(F.avg("score").alias("score_mean"), F.count("score").alias("n"))


@query("snk_artifacts", "region_id:s score_mean tmp_med",
       "SELECT region_id, avg(score) score_mean, quantile_cont(tmp, 0.5) tmp_med FROM train GROUP BY 1")
def snk_artifacts(spark, d):
    from panelcast.operators.cleaning import region_medians
    t = train(spark, d)
    folder = files.fresh(spark, "artifacts")
    files.save_tables(spark, {"region_stats": t.groupBy("region_id").agg(F.avg("score").alias("score_mean")),
                              "medians": region_medians(t, ["tmp"])}, folder)
    return (files.load_table(spark, folder, "region_stats")
            .join(files.load_table(spark, folder, "medians"), "region_id", "left"))


@query("snk_featcache", "region_id:s n_weeks:i built:i", "SELECT region_id, count(*) n_weeks, 1 AS built FROM wk GROUP BY 1")
def snk_featcache(spark, d):
    """Second read of the same fingerprint must be served from the stored table."""
    source = [f"{d}/lineitem.parquet"]
    config = {"stage": "weekly", "channels": ["tmp", "prec"], "run": files.fresh(spark, "run")}
    build = lambda: weekly(spark, d).select("region_id", "week_idx", "tmp_mean", "prec_sum")
    _, first = files.cached_table(spark, source, config, build)
    again, second = files.cached_table(spark, source, config, build)
    return again.groupBy("region_id").agg(F.count("*").alias("n_weeks")).withColumn(
        "built", F.lit(int(not first) + int(not second)))


@query("snk_runlog", "tag:s macro_mae n_runs:i", "SELECT 'zero' AS tag, avg(abs(score)) macro_mae, 1 AS n_runs FROM train "
       "UNION ALL SELECT 'ones', avg(abs(score - 1)), 1 FROM train")
def snk_runlog(spark, d):
    path = files.fresh(spark, "runlog")
    t = train(spark, d)
    for tag in ("zero", "ones"):
        value = 0 if tag == "zero" else 1
        row = t.agg(F.avg(F.abs(F.col("score") - value)).alias("macro_mae")).withColumn("tag", F.lit(tag))
        log = files.append_run(spark, path, row)
    return log.groupBy("tag").agg(F.max("macro_mae").alias("macro_mae"), F.count("*").alias("n_runs"))


@query("chk_panel", "n_regions:i n_rows:i uneven_regions:i bad_scores:i null_scores:i n_items:i undated_items:i orphan_items:i", """
SELECT count(*) n_regions, sum(n) n_rows, count(*) FILTER (n <> 344) uneven_regions, sum(b) bad_scores, sum(z) null_scores,
  (SELECT count(*) FROM lineitem) n_items,
  (SELECT count(*) FROM lineitem WHERE NOT coalesce(l_shipdate >= DATE '1995-01-02' AND l_shipdate < DATE '2001-11-05', false)) undated_items,
  (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)) orphan_items
FROM (SELECT region_id, count(*) n, count(*) FILTER (score < 0 OR score > 5) b, count(*) FILTER (score IS NULL) z
      FROM wk GROUP BY 1)""")
def chk_panel(spark, d):
    """Also the line items that the panel leaves out: shipped outside its days, or of no supplier."""
    items = table(spark, d, "lineitem")
    left_out = left_out_items(items, table(spark, d, "supplier"), between_days(items))
    return attach(panel_violations(weekly(spark, d), 344), left_out, "left_out").select("*", "left_out.*")


@query("chk_targets", "uneven_anchors:i null_targets:i", """
SELECT count(*) FILTER (n <> 344-12-5) uneven_anchors, sum(z) null_targets FROM (
  SELECT region_id, count(*) n, sum(CAST(target_w1 IS NULL OR target_w2 IS NULL OR target_w3 IS NULL
    OR target_w4 IS NULL OR target_w5 IS NULL AS INT)) z FROM anc GROUP BY 1)""")
def chk_targets(spark, d):
    return target_violations(anchors(spark, d), 344 - 12 - 5, [f"target_w{h}" for h in HORIZONS])
