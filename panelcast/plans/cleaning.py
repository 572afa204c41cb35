"""Cleaning queries."""
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, RANK_CHANNELS, TRANSFORMS
from panelcast.functions import ranks
from panelcast.functions.scalars import sanitize
from panelcast.operators import cleaning as cl
from panelcast.operators.rolling import last_weeks, weekly_frames
from panelcast.plans.base import query
from panelcast.plans.inputs import stored_train, test, train, weekly

ROW = "region_id:s day_idx:i " + " ".join(CHANNELS)


def fitted(spark, d):
    t = stored_train(spark, d)
    cut = ranks.bucket_borders(t, CHANNELS)
    return (t, cl.region_medians(t, borders=cut), cl.global_medians(t, borders=cut),
            cl.winsor_bounds(t, borders=cut))


def imputed(spark, d):
    t = stored_train(spark, d)
    cut = ranks.bucket_borders(t, CHANNELS)
    return cl.impute(t, cl.region_medians(t, borders=cut), cl.global_medians(t, borders=cut))


BOUNDS = "SELECT " + ", ".join(
    f"quantile_cont({c}, 0.01) {c}_lo, quantile_cont({c}, 0.99) {c}_hi" for c in CHANNELS) + " FROM train"
MEDS = "SELECT region_id, " + ", ".join(f"quantile_cont({c}, 0.5) {c}_med" for c in CHANNELS) + " FROM train GROUP BY 1"
GMEDS = "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) {c}_g" for c in CHANNELS) + " FROM train"
IMPUTED = ("SELECT t.* REPLACE (" + ", ".join(f"coalesce(t.{c}, m.{c}_med, g.{c}_g) AS {c}" for c in CHANNELS)
           + f") FROM train t LEFT JOIN ({MEDS}) m USING (region_id) CROSS JOIN ({GMEDS}) g")
CLIPPED = lambda src: ("SELECT t.* REPLACE (" + ", ".join(
    f"CASE WHEN t.{c} IS NOT NULL THEN least(greatest(t.{c}, b.{c}_lo), b.{c}_hi) END AS {c}" for c in CHANNELS)
    + f") FROM ({src}) t CROSS JOIN ({BOUNDS}) b")
SQL_T = {"log1p": "ln(1 + CASE WHEN {c} IS NOT NULL THEN greatest({c}, 0) END)",
         "signed_log1p": "sign({c})*ln(1+abs({c}))", "sqrt": "sign({c})*sqrt(abs({c}))"}


def transformed(src, which):
    return "SELECT * REPLACE (" + ", ".join(
        f"{SQL_T[k].format(c=c)} AS {c}" for c, k in which.items()) + f") FROM ({src})"


@query("prep_winsor_fit", "channel:s lo hi", " UNION ALL ".join(
    f"SELECT '{c}' AS channel, quantile_cont({c}, 0.01) lo, quantile_cont({c}, 0.99) hi FROM train" for c in CHANNELS))
def prep_winsor_fit(spark, d):
    return cl.winsor_bounds(stored_train(spark, d))


@query("prep_winsor_apply", ROW, CLIPPED("SELECT * FROM train"))
def prep_winsor_apply(spark, d):
    t = stored_train(spark, d)
    return cl.winsorize(t, cl.winsor_bounds(t))


ALL_T = {"prec": "log1p", "tmp": "signed_log1p", "surf_pre": "sqrt"}


@query("prep_transform", "region_id:s day_idx:i prec tmp surf_pre neg",
       transformed("SELECT *, sign(tmp-30000)*sqrt(abs(tmp-30000)) AS neg FROM train", ALL_T))
def prep_transform(spark, d):
    from panelcast.functions.scalars import transform_named
    t = train(spark, d)
    return cl.apply_transforms(t.withColumn("neg", transform_named("sqrt", F.col("tmp") - 30000)), ALL_T)


@query("prep_impute_fit", "region_id:s " + " ".join(f"{c}_med" for c in CHANNELS),
       f"{MEDS} UNION ALL SELECT 'GLOBAL' AS region_id, * FROM ({GMEDS})")
def prep_impute_fit(spark, d):
    return cl.imputation_table(stored_train(spark, d))


@query("prep_impute_apply", ROW, IMPUTED)
def prep_impute_apply(spark, d):
    return imputed(spark, d)


BOTH = "SELECT * FROM train UNION ALL SELECT * FROM test"


def anchors_sql(c):
    return (f"SELECT unnest(range(0,1000)) q, unnest(quantile_cont({c}, [i/999.0 FOR i IN range(0,1000)])) "
            f"AS value FROM ({BOTH})").replace("[i/999.0 FOR i IN range(0,1000)]",
                                              "[" + ",".join(repr(i / 999) for i in range(1000)) + "]")


@query("prep_rank_fit", "channel:s q:i value",
       " UNION ALL ".join(f"SELECT '{c}' AS channel, q, value FROM ({anchors_sql(c)})" for c in RANK_CHANNELS))
def prep_rank_fit(spark, d):
    return cl.rank_anchors(stored_train(spark, d), test(spark, d), RANK_CHANNELS)


def ranked_sql(src, channels):
    ctes, joins, cols = [], [], []
    for c in channels:
        ctes.append(f"a_{c} AS (SELECT value, max(q)+1 AS below FROM ({anchors_sql(c)}) GROUP BY 1)")
        joins.append(f"ASOF LEFT JOIN a_{c} ON t.{c} > a_{c}.value")
        cols.append(f"CASE WHEN t.{c} IS NOT NULL THEN coalesce(a_{c}.below, 0)/999 END AS {c}")
    return (f"WITH {', '.join(ctes)} SELECT t.* REPLACE ({', '.join(cols)}) FROM ({src}) t {' '.join(joins)}")


@query("prep_rank_apply", "region_id:s day_idx:i " + " ".join(RANK_CHANNELS),
       ranked_sql("SELECT * FROM train", RANK_CHANNELS))
def prep_rank_apply(spark, d):
    t = stored_train(spark, d)
    return cl.rank_normalize(t, cl.rank_anchors(t, test(spark, d), RANK_CHANNELS), RANK_CHANNELS)


PIPE_RANK = RANK_CHANNELS


@query("prep_pipeline", ROW, ranked_sql(transformed(CLIPPED(IMPUTED), TRANSFORMS), PIPE_RANK))
def prep_pipeline(spark, d):
    t, med, overall, bounds = fitted(spark, d)
    anchors = cl.rank_anchors(t, test(spark, d), PIPE_RANK)
    return cl.clean(t, med, overall, bounds, anchors=anchors, rank_channels=PIPE_RANK)


@query("prep_sanitize", "region_id:s day_idx:i x", """
SELECT region_id, day_idx, CASE WHEN prec IS NULL THEN 0 WHEN day_idx % 5 = 0 THEN 5
  WHEN day_idx % 5 = 1 THEN -5 WHEN day_idx % 5 = 2 THEN 0 ELSE prec END AS x FROM train""")
def prep_sanitize(spark, d):
    p, k = F.col("prec"), F.col("day_idx") % 5
    odd = (F.when(k == 0, p * float("inf")).when(k == 1, -p * float("inf")).when(k == 2, p * float("nan")).otherwise(p))
    return train(spark, d).select("region_id", "day_idx", sanitize(odd).alias("x"))


@query("prep_zerofill", ROW, "SELECT region_id, day_idx, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in CHANNELS) + " FROM train")
def prep_zerofill(spark, d):
    return cl.fill_zero(train(spark, d), CHANNELS)


NORM = [f"{c}_mean" for c in CHANNELS]


@query("prep_channel_norm", "region_id:s week_idx:i " + " ".join(f"{c}_z" for c in NORM),
       "SELECT region_id, week_idx, " + ", ".join(f"({c}-{c}_mu)/{c}_sd AS {c}_z" for c in NORM)
       + " FROM wk CROSS JOIN (SELECT " + ", ".join(
           f"avg({c}) {c}_mu, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END {c}_sd" for c in NORM)
       + " FROM wk JOIN gap USING (region_id) WHERE week_idx <= 300 - floor(gap_weeks))")
def prep_channel_norm(spark, d):
    from panelcast.operators.gaps import gap_weeks
    from panelcast.plans.inputs import gapped_train
    cutoff = gap_weeks(gapped_train(spark, d), test(spark, d)).select(
        "region_id", (F.lit(300) - F.floor("gap_weeks")).alias("cutoff"))
    return cl.channel_norm(weekly(spark, d), cutoff, NORM, "week_idx")


@query("prep_instance_norm", "region_id:s week_idx:i " + " ".join(f"{c}_mu {c}_sigma {c}_norm" for c in NORM),
       "SELECT region_id, week_idx, " + ", ".join(
           f"avg({c}) OVER w AS {c}_mu, stddev_pop({c}) OVER w AS {c}_sigma, "
           f"({c} - avg({c}) OVER w)/(stddev_pop({c}) OVER w + 1e-5) AS {c}_norm" for c in NORM)
       + " FROM wk WINDOW w AS (PARTITION BY region_id ORDER BY week_idx ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)")
def prep_instance_norm(spark, d):
    return weekly_frames(weekly(spark, d), cl.instance_norm(NORM, last_weeks(52)), 51)
