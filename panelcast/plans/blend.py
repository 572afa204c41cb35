"""Blending and post-processing."""
from pyspark.sql import functions as F

from panelcast.config import HORIZONS
from panelcast.functions.scalars import clip_score
from panelcast.operators import blend as bl, gaps
from panelcast.plans.base import query
from panelcast.plans.inputs import MEMBERS, aligned, clusters, gapped_train, members, test, train
from panelcast.plans.sources import PRED_COLS, PRED_SQL, predictions

FORMS = {"d": "0.5*m + 0.5*l - 0.1*{h}", "t": "m + 0.05*{h}", "p": "0.8*l"}


def wide(spark, d, form):
    """Three forecasts from each region's mean m and last score l."""
    s = train(spark, d).filter("score is not null").groupBy("region_id").agg(
        F.avg("score").alias("m"), F.max_by("score", "day_idx").alias("l"))
    return s.select("region_id", *[F.expr(f"CAST({FORMS[form].format(h=h)} AS DOUBLE) AS pred_week{h}") for h in HORIZONS])


def _cols(expr):
    return ", ".join(expr.format(**{k: "(" + v.format(h=h) + ")" for k, v in FORMS.items()}) + f" AS pred_week{h}" for h in HORIZONS)


BLEND = "{s}*(0.40*{{d}} + 0.35*{{t}} + 0.25*{{p}})"


@query("bl_weighted", "recipe:s " + PRED_COLS, " UNION ALL ".join(
    "SELECT '" + n + "' AS recipe, * FROM (" + PRED_SQL.format(cols=_cols(BLEND.format(s=repr(s)))) + ")" for n, s in bl.SHRINK.items()))
def bl_weighted(spark, d):
    tables = [wide(spark, d, f) for f in "dtp"]
    out = [bl.weighted_blend(tables, shrink=s).withColumn("recipe", F.lit(n)) for n, s in bl.SHRINK.items()]
    return out[0].unionByName(out[1])


@query("bl_submissions", PRED_COLS, PRED_SQL.format(cols=_cols("least(5, greatest(0, 0.5*{d} + 0.3*{t} + 0.2*{p}))")))
def bl_submissions(spark, d):
    return bl.blend_to_first([wide(spark, d, f) for f in "dtp"], [0.5, 0.3, 0.2])


@query("bl_align", "region_id:s week_idx:i horizon:i p_a p_b p_c truth truth_mismatch:b cluster_id:i", """
SELECT region_id, week_idx, horizon, p_a, p_b, p_c, truth, week_idx % 50 = 7 AND truth <> 0 AS truth_mismatch, cluster_id
FROM al""")
def bl_align(spark, d):
    """Truths of member b differ in some weeks."""
    m = members(spark, d)
    odd = (F.col("member") == "b") & (F.col("week_idx") % 50 == 7)
    return bl.align(m.withColumn("truth", F.when(odd, F.col("truth") / 2).otherwise(F.col("truth"))), MEMBERS, clusters(spark, d))


@query("ml_ens_mean", "region_id:s week_idx:i horizon:i pred", "SELECT region_id, week_idx, horizon, avg(pred) pred FROM mem GROUP BY 1, 2, 3")
def ml_ens_mean(spark, d):
    return bl.mean_of_members(members(spark, d))


def objective_sql(weights):
    rows = ", ".join(f"({i}, {a!r}, {b!r}, {c!r})" for i, (a, b, c) in enumerate(weights))
    return f"""SELECT weight_id, any_value(w_a) w_a, any_value(w_b) w_b, any_value(w_c) w_c, avg(mm) FILTER (cluster_id >= 0) cluster_mae, any_value(macro) macro_mae FROM (
  SELECT weight_id, cluster_id, any_value(w_a) w_a, any_value(w_b) w_b, any_value(w_c) w_c, avg(e/n) mm, any_value(macro) macro FROM (
    SELECT *, avg(he) OVER (PARTITION BY weight_id) AS macro FROM (
      SELECT *, sum(e) OVER (PARTITION BY weight_id, horizon)/sum(n) OVER (PARTITION BY weight_id, horizon) he FROM (
        SELECT weight_id, cluster_id, horizon, any_value(w_a) w_a, any_value(w_b) w_b, any_value(w_c) w_c, count(*) n, sum(abs(w_a*p_a + w_b*p_b + w_c*p_c - truth)) e
        FROM al CROSS JOIN (SELECT * FROM (VALUES {rows}) AS t(weight_id, w_a, w_b, w_c)) GROUP BY 1, 2, 3))) GROUP BY 1, 2) GROUP BY 1"""


GRID = bl.simplex_grid()


# A report: the fifteen best weight rows; the error is rounded so that equal rows keep their order.
@query("bl_grid", "w_a w_b w_c cluster_mae macro_mae", f"SELECT * FROM ({objective_sql(GRID)}) ORDER BY floor(cluster_mae*1e9+0.5), weight_id LIMIT 15")
def bl_grid(spark, d):
    return bl.grid_search(aligned(spark, d), MEMBERS, GRID)


@query("bl_grid_macro", "w_a w_b w_c cluster_mae macro_mae", f"SELECT * FROM ({objective_sql(GRID)}) ORDER BY floor(macro_mae*1e9+0.5), weight_id LIMIT 15")
def bl_grid_macro(spark, d):
    return bl.grid_search(aligned(spark, d), MEMBERS, GRID, "macro_mae")


# The weight sets the reports compare.
CANDIDATES = [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (0.5, 0.0, 0.5), (0.6, 0.0, 0.4), (0.45, 0.1, 0.45),
              (0.4, 0.2, 0.4), (0.333, 0.334, 0.333), (0.5, 0.2, 0.3)]


@query("bl_candidates", "weight_id:i cluster_mae macro_mae", objective_sql(CANDIDATES))
def bl_candidates(spark, d):
    return bl.score_weights(aligned(spark, d), MEMBERS, CANDIDATES)


@query("bl_hillclimb_first", "weight_id:i cluster_mae macro_mae", f"""
SELECT * FROM ({objective_sql([(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)])}) ORDER BY cluster_mae, weight_id LIMIT 1""")
def bl_hillclimb_first(spark, d):
    """First greedy step: the best single member."""
    scores = bl.score_weights(aligned(spark, d), MEMBERS, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    return scores.orderBy("cluster_mae", "weight_id").limit(1)


# Each step scores the three moves on the distinct cells and keeps the best, as long as it gains 1e-6.
CLIMB = """WITH RECURSIVE cells AS MATERIALIZED (
  SELECT cluster_id, horizon, p_a, p_b, p_c, truth, count(*) n FROM al GROUP BY ALL),
moves AS (SELECT * FROM (VALUES (0, 0.02::DOUBLE, 0::DOUBLE, 0::DOUBLE), (1, 0, 0.02, 0), (2, 0, 0, 0.02)) AS t(i, a, b, c)),
climb AS (
  SELECT 0 AS step, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c, CAST(NULL AS DOUBLE) AS best
  UNION ALL
  SELECT step, a, b, c, score FROM (
    SELECT step, min_by(a, score) a, min_by(b, score) b, min_by(c, score) c, min(score) score, any_value(best) best FROM (
      SELECT step, i, any_value(a) a, any_value(b) b, any_value(c) c, any_value(best) best,
        coalesce(avg(m) FILTER (cluster_id >= 0), avg(m)) AS score FROM (
        SELECT step, i, cluster_id, any_value(a) a, any_value(b) b, any_value(c) c, any_value(best) best, avg(e) AS m FROM (
          SELECT s.step + 1 AS step, m.i, cluster_id, horizon, any_value(s.a + m.a) a, any_value(s.b + m.b) b, any_value(s.c + m.c) c, any_value(s.best) best,
            sum(n*abs(((s.a + m.a)*p_a + (s.b + m.b)*p_b + (s.c + m.c)*p_c)/(s.a + s.b + s.c + 0.02) - truth))/sum(n) AS e
          FROM climb s CROSS JOIN moves m CROSS JOIN cells WHERE s.step < 200 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)
  WHERE best IS NULL OR score < best - 1e-6),
reached AS (SELECT * FROM climb ORDER BY step DESC LIMIT 1)
SELECT 'a' AS member, a/(a + b + c) AS weight, best AS objective FROM reached UNION ALL
SELECT 'b', b/(a + b + c), best FROM reached UNION ALL SELECT 'c', c/(a + b + c), best FROM reached"""


@query("bl_hillclimb", "member:s weight objective", CLIMB)
def bl_hillclimb(spark, d):
    weights, history = bl.hill_climb(aligned(spark, d), MEMBERS, step=0.02, max_steps=200)
    rows = [(m, w, history[-1][1] if history else None) for m, w in zip(MEMBERS, weights)]
    return spark.createDataFrame(rows, "member string, weight double, objective double")


@query("bl_corr", "member_a:s member_b:s corr", " UNION ALL ".join(
    f"SELECT '{a}' AS member_a, '{b}' AS member_b, avg(c) AS corr FROM (SELECT horizon, corr(p_{a}, p_{b}) c FROM al GROUP BY 1)"
    for i, a in enumerate(MEMBERS) for b in MEMBERS[i:]))
def bl_corr(spark, d):
    return bl.member_correlations(aligned(spark, d, False), MEMBERS)


SHIFT = """SELECT region_id, n_nonzero, CASE WHEN n_nonzero >= 8 THEN least(greatest(m, -0.5), 0.5) ELSE 0 END AS shift FROM (
  SELECT region_id, count(*) FILTER (top > 0) n_nonzero, sum(r)/sum(n) m FROM (
    SELECT region_id, week_idx, max(truth) top, sum(pred - truth) r, count(*) n FROM mem WHERE member = 'c' GROUP BY 1, 2) GROUP BY 1)"""


@query("bl_region_shift", "region_id:s week_idx:i horizon:i n_nonzero:i shift pred", f"""
SELECT region_id, week_idx, horizon, n_nonzero, shift, least(5, greatest(0, pred - shift)) AS pred FROM mem JOIN ({SHIFT}) USING (region_id) WHERE member = 'c'""")
def bl_region_shift(spark, d):
    m = members(spark, d).filter("member = 'c'")
    shifts = bl.region_shifts(m)
    return bl.apply_shifts(m, shifts).join(shifts, "region_id")


@query("bl_clip", "region_id:s horizon:i clipped rounded", """
SELECT region_id, unnest([1,2,3,4,5]) horizon, unnest([least(5, greatest(0, 0.5*m + 0.5*l - 0.1*h)) FOR h IN [1,2,3,4,5]]) clipped,
  unnest([round_even(least(5, greatest(0, 0.5*m + 0.5*l - 0.1*h)), 0) FOR h IN [1,2,3,4,5]]) rounded
FROM (SELECT region_id, avg(score) m, max_by(score, day_idx) l FROM train WHERE score IS NOT NULL GROUP BY 1)""")
def bl_clip(spark, d):
    p = predictions(spark, d)
    return p.select("region_id", "horizon", clip_score(F.col("pred")).alias("clipped"), clip_score(F.col("pred"), True).alias("rounded"))


@query("ml_strata_blend", "region_id:s horizon:i soft hard", """
SELECT region_id, horizon, CASE WHEN s IS NULL THEN l WHEN l IS NULL THEN s ELSE least(5, greatest(0, (1-w)*s + w*l)) END AS soft,
  CASE WHEN s IS NULL THEN l WHEN l IS NULL THEN s WHEN gap_weeks < 13 THEN s ELSE l END AS hard FROM (
  SELECT region_id, unnest([1,2,3,4,5]) horizon, least(greatest((gap_weeks-13)/4, 0), 1) w, gap_weeks,
    1.5 s, m l
  FROM (SELECT region_id, avg(score) m FROM train GROUP BY 1) JOIN gap USING (region_id))""")
def ml_strata_blend(spark, d):
    """A flat short-gap forecast and a region-mean long-gap forecast."""
    base = train(spark, d).groupBy("region_id").agg(F.avg("score").alias("m")).withColumn(
        "horizon", F.explode(F.sequence(F.lit(1), F.lit(5))))
    short = base.select("region_id", "horizon", F.lit(1.5).alias("pred"))
    long = base.select("region_id", "horizon", F.col("m").alias("pred"))
    g = gaps.gap_weeks(gapped_train(spark, d), test(spark, d))
    soft = bl.blend_strata(short, long, g).withColumnRenamed("pred", "soft")
    return soft.join(bl.blend_strata(short, long, g, soft=False).withColumnRenamed("pred", "hard"), ["region_id", "horizon"])
