"""Common table expressions shared by the SQL counterparts of the queries."""
from panelcast.config import CHANNELS, HORIZONS, STATS


def stat_sql(ch, stat):
    return {"mean": f"avg({ch})", "std": f"stddev_pop({ch})", "min": f"min({ch})",
            "max": f"max({ch})", "sum": f"coalesce(sum({ch}),0)",
            "p95": f"quantile_cont({ch},0.95)"}[stat]


def weekly_sql(stats=STATS, channels=CHANNELS):
    return ", ".join(f"{stat_sql(c, s)} AS {c}_{s}" for c in channels for s in stats)


WEEK_COLS = [f"{c}_{s}" for c in CHANNELS for s in STATS]

_CH = ", ".join(CHANNELS)

PREFIX = f"""
obs AS (
  SELECT s_nationkey nk, date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) day_idx,
    count(*) n, sum(l_quantity) qty, sum(CAST(round(l_extendedprice*100) AS BIGINT)) cents,
    max(l_extendedprice) hi, min(l_extendedprice) lo,
    sum(CAST(round(l_discount*100) AS BIGINT)) disc, sum(l_orderkey % 1000) okey, sum(l_partkey) pkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
days AS (
  SELECT nk, unnest(range(0, 2499)) day_idx FROM (SELECT DISTINCT s_nationkey nk FROM supplier)),
dense AS (
  SELECT 'R' || nk AS region_id, d.nk, d.day_idx,
    DATE '1995-01-02' + CAST(d.day_idx AS INTEGER) dt, coalesce(n, 0) n,
    disc/n humidity, cents/n/100 tmp, hi-lo tmp_range, hi tmp_max, lo tmp_min,
    pkey/n surf_tmp, okey/n surf_pre, qty prec
  FROM days d LEFT JOIN obs USING (nk, day_idx)),
cal AS (
  SELECT *, tmp*(1-humidity/100) wb_tmp, strftime(dt, '%Y-%m-%d') AS date,
    CAST(year(dt) AS BIGINT) AS year, CAST(month(dt) AS BIGINT) AS month, CAST(day(dt) AS BIGINT) AS day,
    [0,31,59,90,120,151,181,212,243,273,304,334][month(dt)] + day(dt) AS doy,
    [0,31,60,91,121,152,182,213,244,274,305,335][month(dt)] + day(dt) AS doy366,
    date_diff('day', DATE '0001-01-01', dt) + 1 AS true_gord,
    sum(n) OVER (PARTITION BY nk, day_idx // 7) % 12 AS n7
  FROM dense),
panel AS (
  SELECT region_id, nk, CAST(day_idx AS BIGINT) day_idx, date, {_CH}, year, month, day, doy, doy366,
    least(52, (doy-1)//7) AS woy, (doy366-1)//7+1 AS woy1, (year-1)*366+doy366 AS ord, true_gord AS gord,
    CASE WHEN day_idx % 7 = 6 THEN CASE WHEN n7 < 7 THEN 0 ELSE n7-6 END END AS score
  FROM cal),
train AS (SELECT * FROM panel WHERE day_idx < 2408),
test AS (SELECT * REPLACE (day_idx-2408 AS day_idx, NULL AS score) FROM panel WHERE day_idx >= 2408),
gtrain AS (SELECT * FROM panel WHERE day_idx < 2408 - 126*(nk % 5)),
wk AS (
  SELECT region_id, day_idx//7 AS week_idx, {weekly_sql()},
    max_by(month, day_idx) AS month, max_by(doy, day_idx) AS doy, max_by(doy366, day_idx) AS doy366,
    max_by(woy, day_idx) AS woy, max_by(woy1, day_idx) AS woy1, max_by(ord, day_idx) AS ord,
    max(score) AS score
  FROM train GROUP BY 1, 2),
wtest AS (
  SELECT region_id, day_idx//7 AS week_idx, {weekly_sql()},
    max_by(month, day_idx) AS month, max_by(doy, day_idx) AS doy, max_by(doy366, day_idx) AS doy366,
    max_by(woy, day_idx) AS woy, max_by(woy1, day_idx) AS woy1, max_by(ord, day_idx) AS ord
  FROM test GROUP BY 1, 2),
tmeta AS (
  SELECT region_id, max_by(woy, day_idx) AS test_woy, max_by(woy1, day_idx) AS test_woy1,
    min_by(month, day_idx) AS test_month, max_by(month, day_idx) AS end_month,
    max_by(ord, day_idx) AS test_ord, max_by(doy366, day_idx) AS test_doy
  FROM test GROUP BY 1),
gap AS (
  SELECT region_id, (min(s.sg) - max(gord)) / 7 AS gap_weeks
  FROM gtrain JOIN (SELECT region_id, min(gord) sg FROM test GROUP BY 1) s USING (region_id) GROUP BY 1),
anc AS (
  SELECT region_id, week_idx, month, doy, doy366, woy, woy1, ord, score, prec_sum, prec_mean, tmp_max_mean,
    {", ".join(f"lead(score,{h}) OVER w AS target_w{h}" for h in HORIZONS)}
  FROM wk WINDOW w AS (PARTITION BY region_id ORDER BY week_idx)
  QUALIFY week_idx BETWEEN 12 AND max(week_idx) OVER (PARTITION BY region_id) - 5),
clus AS (
  SELECT region_id, avg(score) AS score_mean, CAST(floor(avg(score)*2) AS BIGINT) AS region_cluster_id
  FROM wk GROUP BY 1),
al AS (
  SELECT a.region_id, a.week_idx, a.ord, a.month, a.score, horizon, truth, CAST(a.score AS DOUBLE) p_a, r.m p_b,
    0.5*a.score + 0.5*s.m p_c, coalesce(region_cluster_id, -1) cluster_id
  FROM (SELECT *, unnest([1,2,3,4,5]) horizon,
          unnest([target_w1,target_w2,target_w3,target_w4,target_w5]) truth FROM anc) a
  JOIN (SELECT region_id, avg(score) m FROM wk GROUP BY 1) r USING (region_id)
  JOIN (SELECT region_id, month, avg(score) m FROM wk GROUP BY 1, 2) s USING (region_id, month)
  LEFT JOIN clus USING (region_id)),
mem AS (
  SELECT 'a' AS member, region_id, week_idx, horizon, p_a AS pred, truth FROM al
  UNION ALL SELECT 'b', region_id, week_idx, horizon, p_b, truth FROM al
  UNION ALL SELECT 'c', region_id, week_idx, horizon, p_c, truth FROM al)
"""
