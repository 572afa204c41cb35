"""The score known for a target: the last one, else a dated proxy estimate, else the region's mean."""
from pyspark.sql import functions as F

from panelcast.operators import asof, climatology as cl, indices as ix
from panelcast.plans.base import query
from panelcast.plans.indices import COEF, SIG_SQL
from panelcast.plans.inputs import gapped_train
from panelcast.plans.lags import ASOF_SQL, targets
from panelcast.sources.files import fresh, load_table, save_tables, store

#: Proxy models in force from a day on, as refits would leave them: the fitted ones change with the platform's arithmetic,
#: so the queries store and read back these, which SQL can repeat.
REFITS = {300: (0.9, COEF), 1300: (0.7, [round(0.8 * c, 4) for c in COEF])}
SIGNALS = ix.signal_names()


def proxy_days(spark, d):
    """Daily proxy estimates of the shortened history by the stored models."""
    folder = fresh(spark, "proxy-models")
    rows = [(first, t, float(v)) for first, (level, coef) in REFITS.items() for t, v in [*zip(SIGNALS, coef), ("(intercept)", level)]]
    save_tables(spark, {"proxy": spark.createDataFrame(rows, "valid_from long, term string, value double")}, folder)
    t = gapped_train(spark, d)
    days = asof.dated_scores(ix.proxy_signals(t, cl.region_meteo(t)), load_table(spark, folder, "proxy"), SIGNALS)
    return store(days, "proxy-days")  # sums of 21 signals; left in the plan, the optimizer would infer constraints over them without end


def known_targets(spark, d):
    """Targets with the score known for them: the last one, else the proxy estimate, else the region's mean."""
    means = gapped_train(spark, d).groupBy("region_id").agg(F.avg("score").alias("m"))
    out = asof.with_dated_proxy(targets(spark, d), proxy_days(spark, d)).join(means, "region_id")
    last, proxy = F.col("last_score"), F.col("proxy")
    return out.withColumns({"known": asof.known_score(last, proxy, F.col("m")), "known_from": asof.known_from(last, proxy)})


_CASES = " ".join(f"WHEN day_idx >= {first} THEN " + " + ".join(f"{n}*{k}" for n, k in zip(SIGNALS, coef)) + f" + {level}"
                  for first, (level, coef) in sorted(REFITS.items(), reverse=True))
KNOWN_SQL = f"""WITH a AS ({ASOF_SQL}), days AS (SELECT * FROM (
  SELECT region_id, day_idx, CASE {_CASES} END AS proxy FROM ({SIG_SQL.replace("FROM train", "FROM gtrain")})) WHERE proxy IS NOT NULL)
SELECT a.*, days.proxy, coalesce(last_score, CASE WHEN days.proxy IS NOT NULL THEN least(greatest(days.proxy, 0), 5) END, m) AS known,
  CASE WHEN last_score IS NOT NULL THEN 'score' WHEN days.proxy IS NOT NULL THEN 'proxy' ELSE 'mean' END AS known_from
FROM a JOIN (SELECT region_id, avg(score) m FROM gtrain GROUP BY 1) USING (region_id)
ASOF LEFT JOIN days ON a.region_id = days.region_id AND days.day_idx < a.window_end"""


@query("asof_last_score", "region_id:s target_pos:i horizon:i last_score:i known known_from:s", KNOWN_SQL)
def asof_last_score(spark, d):
    return known_targets(spark, d)


@query("asof_sources", "horizon:i known_from:s n:i", f"SELECT horizon, known_from, count(*) n FROM ({KNOWN_SQL}) GROUP BY 1, 2")
def asof_sources(spark, d):
    """How many targets take the last score, the proxy estimate and the region's mean."""
    return known_targets(spark, d).groupBy("horizon", "known_from").agg(F.count("*").alias("n"))


@query("score_decay", "region_id:s target_pos:i horizon:i decayed",
       f"SELECT region_id, target_pos, horizon, known * pow(0.96, score_gap) AS decayed FROM ({KNOWN_SQL})")
def score_decay(spark, d):
    return known_targets(spark, d).withColumn("decayed", asof.decayed(F.col("known"), F.col("score_gap")))
