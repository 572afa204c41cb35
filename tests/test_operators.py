"""Edge rules on hand-written panels."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.config import CHANNELS
from panelcast.operators import (asof, blend, cleaning, climatology as clim, drift, lags, metrics, models, splits, weekly,
                                 weights)
from panelcast.operators.rolling import sequence_decomposition, sequence_window


def daily(spark, values, scores, region="R1"):
    rows = [(region, i, *([v] * len(CHANNELS)), scores.get(i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region_id string, day_idx long, " + ", ".join(f"{c} double" for c in CHANNELS) + ", score long")


def weeks(spark, scores, region="R1"):
    return spark.createDataFrame([(region, i, s) for i, s in enumerate(scores)], "region_id string, week_idx long, score long")


def test_short_head_uses_the_rows_there_are(spark):
    df = daily(spark, [1.0, 2.0, 3.0, 4.0, 5.0], {4: 2})
    (r,) = weekly.weekly_at_anchors(df).collect()
    assert (r.week_idx, r.tmp_mean, r.tmp_sum, r.score) == (0, 3.0, 15.0, 2)
    assert r.tmp_p95 == pytest.approx(np.percentile([1, 2, 3, 4, 5], 95))
    assert weekly.weekly_at_anchors(df, strict=True).count() == 0
    assert weekly.weekly_blocks_back(df).count() == 0


def test_all_null_week(spark):
    df = daily(spark, [None] * 7, {6: 0})
    (r,) = weekly.weekly_at_anchors(df).collect()
    assert r.tmp_mean is None and r.tmp_p95 is None and r.tmp_sum == 0.0
    assert cleaning.fill_zero(weekly.weekly_at_anchors(df), ["tmp_mean"]).first().tmp_mean == 0.0


def test_overlapping_anchors_and_irregular_scores(spark):
    df = daily(spark, [float(i) for i in range(12)], {3: 1, 5: 2, 11: 3})
    r = {x.week_idx: x for x in weekly.weekly_at_anchors(df).collect()}
    assert [r[i].tmp_mean for i in range(3)] == [1.5, 2.5, 8.0]
    assert [r[i].score for i in range(3)] == [1, 2, 3]


def test_blocks_equal_anchors_on_a_regular_panel(spark):
    df = daily(spark, [float(i * i % 17) for i in range(70)], {i: i % 6 for i in range(6, 70, 7)})
    cols = ["week_idx", "score", "tmp_mean", "tmp_std", "tmp_p95", "tmp_max"]
    a = sorted(weekly.weekly_at_anchors(df).select(cols).collect())
    b = sorted(weekly.weekly_blocks(df, keep=["score"]).select(cols).collect())
    assert len(a) == len(b) == 10
    for x, y in zip(a, b):
        assert tuple(map(float, x)) == pytest.approx(tuple(map(float, y)))


def test_score_history_edges(spark):
    scores = [0] * 20 + [3] + [0] * 40
    r = {x.week_idx: x for x in lags.with_score_history(weeks(spark, scores)).collect()}
    assert r[5].score_lag1 == 0 and r[5].weeks_since_last_nonzero == 26 and r[5].max_score_prev8 == 0
    assert r[33].score_lag1 == 3 and r[33].weeks_since_last_nonzero == 1
    assert r[58].weeks_since_last_nonzero == 26 and r[59].weeks_since_last_nonzero == 26
    assert [r[i].max_score_prev8 for i in (32, 33, 40, 41)] == [0, 3, 3, 0]
    last = lags.last_score_history(weeks(spark, [0, 4, 0, 1])).first()
    assert (last.score_lag1, last.score_lag2, last.score_lag4, last.score_lag8) == (1, 0, 0, 0)
    assert last.weeks_since_last_nonzero == 1 and last.max_score_prev8 == 4


def test_targets_by_ordinal_survive_a_missing_week(spark):
    rows = [("R1", i, 7 * (i + (1 if i >= 15 else 0)), i % 6) for i in range(20)]
    w = spark.createDataFrame(rows, "region_id string, week_idx long, ord long, score long")
    r = {x.week_idx: x for x in lags.targets_by_ordinal(w).collect()}
    assert r[14].target_w1 is None and r[14].target_w2 == 15 % 6
    assert r[18].target_w1 == 19 % 6 and r[18].target_w2 is None and 19 not in r


def test_asof_gap(spark):
    df = daily(spark, [1.0] * 60, {3: 1, 17: 2, 18: 3, 40: 4}).withColumn("gord", F.col("day_idx") + 1000).withColumn("month", F.lit(1))
    def ask(gap):
        g = spark.createDataFrame([("R1", float(gap))], "region_id string, gap_weeks double")
        t = asof.window_ends(df).filter("target_pos = 40 AND horizon = 1")
        return asof.asof_scores(t, df, g).first()
    r = ask(0)                                    # window ends before day 34
    assert (r.last_score, r.score_gap) == (3, pytest.approx(22 / 7))
    assert ask(2.3).last_score == 2               # cut of 16 days: before day 18
    r = ask(6)
    assert r.last_score is None and r.score_gap == 6.0
    r = asof.asof_scores(asof.window_ends(df).filter("target_pos = 3 AND horizon = 5"), df,
                         spark.createDataFrame([("R1", 0.0)], "region_id string, gap_weeks double")).first()
    assert r.last_score == 1                      # a window has at least seven rows


def test_closest_tie_takes_the_later_week(spark):
    df = spark.createDataFrame([("R1", 1, 2), ("R1", 9, 2), ("R1", 5, 3)], "region_id string, week_idx long, woy_dist long")
    assert splits.closest_row(df).first().week_idx == 9


def test_purged_folds(spark):
    df = spark.createDataFrame([(f"R{r}", 7 * i, 1, i) for i in range(40) for r in (1, 2, 10)],
                               "region_id string, ord long, horizon int, week_idx long")
    rows = splits.purged_folds(df, 4, 21, chunk=32).collect()
    order = sorted(df.collect(), key=lambda r: (r.ord, int(r.region_id[1:])))
    size = len(order) // 4
    for f in (1, 2, 3):
        val = order[f * size:(f + 1) * size if f < 3 else None]
        train = [r for r in order if r.ord <= val[0].ord - 21]
        got = {p: sorted((r.region_id, r.ord) for r in rows if r.fold == f and r.part == p) for p in ("train", "val")}
        assert got["val"] == sorted((r.region_id, r.ord) for r in val)
        assert got["train"] == sorted((r.region_id, r.ord) for r in train)


def test_hashed_choices_are_stable_and_disjoint(spark):
    df = spark.range(5000).selectExpr("concat('R', id % 50) AS region_id", "id AS week_idx")
    a, b = (splits.random_split(df, ["region_id", "week_idx"]).filter("part = 'val'") for _ in range(2))
    assert a.count() == b.count() == a.intersect(b).count()
    assert 350 < a.count() < 650


def test_recent_biased_sample(spark):
    s = spark.createDataFrame([("R1", i, 0) for i in range(500)] + [("R2", i, 0) for i in range(9)] + [("R3", i, 0) for i in range(30)],
                              "region_id string, day_idx long, score long")
    r = {x.region_id: x for x in splits.recent_biased(s, k=100, chunk=64).groupBy("region_id").agg(
        F.count("*").alias("n"), F.min("day_idx").alias("lo")).collect()}
    assert r["R1"].n == 100 and r["R1"].lo >= 300 and r["R3"].n == 30 and "R2" not in r


def test_unseen_cell_falls_back(spark):
    pool = spark.createDataFrame([("R1", 1, 2), ("R1", 1, 4), ("R2", 2, 1)], "region_id string, month long, score long")
    rows = spark.createDataFrame([("R1", 1), ("R1", 9), ("R9", 1)], "region_id string, month long")
    r = {(x.region_id, x.month): x.region_month_score_mean for x in clim.season_scalars(rows, pool).collect()}
    assert r == {("R1", 1): 3.0, ("R1", 9): 3.0, ("R9", 1): pytest.approx(7 / 3)}


def test_ks_ties(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in v], "x double") for v in ([1, 1, 2], [1, 2, 2]))
    r = drift.ks_distance(a, b, ["x"]).first()
    assert r.ks == pytest.approx(1 / 3) and r.mean_delta == pytest.approx(1 / 3) and (r.train_median, r.test_median) == (1.0, 2.0)


def test_transition_rows_sum_to_one(spark):
    cells = drift.transitions(weeks(spark, [0, 0, 1, 3, 5, 0, 2, 0, 0, 1]))
    for r in cells.groupBy("lag", "from").agg(F.sum("p").alias("s")).collect():
        assert r.s == pytest.approx(1.0)


def test_partial_autocorrelation(spark):
    rng = np.random.default_rng(0)
    x = [int(v) for v in np.clip(np.cumsum(rng.integers(-1, 2, 300)) % 6, 0, 5)]
    a = drift.autocorrelation(weeks(spark, x), 6).withColumn("p", drift.partial_autocorrelation("acf")).first()
    d = np.array(x) - np.mean(x)
    acf = [float((d[:len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(7)]
    assert a.acf == pytest.approx(acf)
    for k in range(1, 7):
        toeplitz = np.array([[acf[abs(i - j)] for j in range(k)] for i in range(k)])
        assert a.p[k] == pytest.approx(np.linalg.solve(toeplitz, acf[1:k + 1])[-1])


def test_isotonic_ties(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 0.5), (4.0, 2.0), (4.0, 4.0)], "pred double, truth double")
    out = models.calibrated(rows, rows.withColumn("x", F.col("pred"))).orderBy("x").collect()
    assert [r.pred for r in out] == pytest.approx([0, 0.75, 0.75, 3, 3])


@pytest.mark.parametrize("standardize", [False, True])
def test_ridge_matches_the_closed_form(spark, standardize):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.3]
    y = x @ [1.0, -0.2, 2.0] + 3 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    m = models.ridge(df, ["a", "b", "c"], "y", 10.0, standardize)
    scale = x.std(axis=0, ddof=1 if standardize else 0) if standardize else np.ones(3)
    z = (x - x.mean(axis=0)) / scale
    want = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean())) / scale
    assert list(m.coefficients) == pytest.approx(list(want), rel=2e-3)


def test_sequence_padding_and_decomposition(spark):
    w = spark.createDataFrame([("R1", i, float(v)) for i, v in enumerate([2, 4, 8, 16])], "region_id string, week_idx long, x double")
    s = sequence_window(w, ["x"], 3)
    trend, season = sequence_decomposition(F.col("x_seq"), 3)
    r = {x.week_idx: x for x in s.withColumns({"t": trend, "s": season}).collect()}
    assert r[0].x_seq == [2, 2, 2] and r[1].x_seq == [2, 2, 4] and r[3].x_seq == [4, 8, 16]
    assert r[3].t == pytest.approx([16 / 3, 28 / 3, 40 / 3])
    assert [a + b for a, b in zip(r[3].t, r[3].s)] == pytest.approx([4, 8, 16])


def test_imputation_of_a_random_table(spark):
    rng = np.random.default_rng(0)
    rows = [(f"R{i % 10}", None if rng.random() < 0.01 or i % 10 == 7 else float(rng.normal())) for i in range(5000)]
    df = spark.createDataFrame(rows, "region_id string, tmp double")
    table = cleaning.imputation_table(df, ["tmp"])
    got = {r.region_id: r.tmp_med for r in table.collect()}
    by = {k: [v for r, v in rows if r == k and v is not None] for k in {r for r, _ in rows}}
    assert set(got) == set(by) | {"GLOBAL"} and got["R7"] is None
    assert got["R1"] == pytest.approx(np.median(by["R1"])) and got["GLOBAL"] == pytest.approx(np.median(sum(by.values(), [])))
    out = cleaning.impute(df, table.filter("region_id <> 'GLOBAL'"), cleaning.global_medians(df, ["tmp"]), ["tmp"])
    assert out.filter("tmp IS NULL").count() == 0 and out.count() == 5000
    bounds = cleaning.winsor_bounds(df, ["tmp"])
    clipped = cleaning.winsorize(df, bounds, ["tmp"]).agg(F.min("tmp"), F.max("tmp"), F.count_if(F.col("tmp").isNull())).first()
    v = sum(by.values(), [])
    assert clipped[0] == pytest.approx(np.quantile(v, 0.01)) and clipped[1] == pytest.approx(np.quantile(v, 0.99))
    assert clipped[2] == 5000 - len(v)


def test_rank_normalisation_matches_searchsorted(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([np.full(60, 2.0), rng.normal(size=140)])
    df = spark.createDataFrame([(i, float(v) if i % 11 else None) for i, v in enumerate(a)], "i int, x double")
    grid = cleaning.rank_anchors(df, df.limit(0), ["x"], 50)
    v = np.array([x for i, x in enumerate(a) if i % 11])
    anchors = np.quantile(v, np.linspace(0, 1, 50))
    got = {r.i: r.x for r in cleaning.rank_normalize(df, grid, ["x"], 50).collect()}
    for i, x in enumerate(a):
        if i % 11 == 0:
            assert got[i] is None
        elif np.min(np.abs(anchors - x)) > 1e-9 or x == 2.0:
            assert got[i] == pytest.approx(np.searchsorted(anchors, x, side="left") / 49)


def test_weights_have_unit_mean(spark):
    df = spark.createDataFrame([(float(i % 6), i / 100) for i in range(100)], "y double, p double").withColumn(
        "w", weights.severity(F.col("y")) * weights.density_ratio(F.col("p")))
    out = weights.with_unit_mean(df, "w")
    assert out.agg(F.avg("w")).first()[0] == pytest.approx(1.0)
    assert 0 < weights.effective_size(out, "w").first().ess_share <= 1


def test_hill_climb_finds_the_better_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(f"R{i % 5}", i // 5, 1 + i % 5, float(t + 1), float(t - 1), float(t + 5), float(t), 0) for i, t in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "region_id string, week_idx long, horizon int, p_a double, p_b double, p_c double, truth double, cluster_id int")
    w, history = blend.hill_climb(df, ["a", "b", "c"], step=0.25, max_steps=10)
    assert w == pytest.approx([0.5, 0.5, 0.0]) and history[-1][1] == pytest.approx(0.0, abs=1e-9)
    grid = blend.grid_search(df, ["a", "b", "c"], blend.simplex_grid(4), top=1).first()
    assert (grid.w_a, grid.w_b, grid.w_c) == (0.5, 0.5, 0.0)
    with pytest.raises(ValueError):
        blend.blend_to_first([df, df], [0.5, 0.6])


def test_region_shift_needs_nonzero_weeks(spark):
    rows = [("R1", w, 1, 2.0, 1.0) for w in range(8)] + [("R2", w, 1, 2.0, 1.0) for w in range(7)] + [("R3", w, 1, 1.2, 1.0) for w in range(9)]
    df = spark.createDataFrame(rows, "region_id string, week_idx long, horizon int, pred double, truth double")
    s = {r.region_id: r.shift for r in blend.region_shifts(df).collect()}
    assert s == {"R1": 0.5, "R2": 0.0, "R3": pytest.approx(0.2)}


def test_ragged_errors_skip_missing_targets(spark):
    df = spark.createDataFrame([("R1", 1, 1, 1.0, 2.0), ("R1", 1, 2, 1.0, None), ("R1", 1, 3, 1.0, 4.0)],
                               "region_id string, week_idx long, horizon int, pred double, truth double")
    r = metrics.macro_mae(df).first()
    assert r.mae_w1 == 1.0 and r.mae_w2 is None and r.macro_mae == 2.0


def _fold_rows(spark, n):
    rows = [("R1", k, h, k + h, float((k % 7) + h) / 4, 0, "val" if k % 3 == 0 else "train") for k in range(n) for h in range(1, 6)]
    return spark.createDataFrame(rows, "region_id string, ord int, horizon int, x int, truth double, fold int, part string")


def test_each_horizon_has_its_own_fold_models(spark):
    seen = []

    def fit(rows, cols, label):
        seen.append({r.horizon for r in rows.select("horizon").distinct().collect()})
        return models.ridge(rows, cols, label, 1.0)
    scored, fits = models.out_of_fold_by_horizon(_fold_rows(spark, 60).withColumn("fold", F.lit(1)), ["x"], "truth", fit, [1])
    assert sorted(fits) == [1, 2, 3, 4, 5] and all(len(m) == 1 for m in fits.values())
    assert seen == [{1}, {2}, {3}, {4}, {5}]
    assert {(r.horizon, r["count"]) for r in scored.groupBy("horizon").count().collect()} == {(h, 20) for h in range(1, 6)}


def test_without_folds_the_late_rows_are_scored(spark):
    fit = lambda rows, cols, label: models.ridge(rows, cols, label, 1.0)
    scored, fits = models.out_of_fold_by_horizon(_fold_rows(spark, 10), ["x"], "truth", fit, [1, 2])
    assert all(len(m) == 1 for m in fits.values())
    got = scored.groupBy("horizon").agg(F.min("ord").alias("a"), F.count("*").alias("n"), F.max("fold").alias("f")).collect()
    assert {(r.a, r.n, r.f) for r in got} == {(8, 2, 0)}
    scored, fits = models.out_of_fold_by_horizon(_fold_rows(spark, 10).limit(0), ["x"], "truth", fit, [1])
    assert scored.count() == 0 and not any(fits.values())


def test_isotonic_input_is_bounded(spark):
    from panelcast.operators import monotone
    rows = spark.range(1_000_000).select((F.col("id") / 200_000).alias("pred"), (F.col("id") / 200_000).alias("truth"))
    fitted = monotone.pools(rows)
    assert fitted.count() <= 50_001
    worst = models.calibrated(rows, rows.filter("pred < 4.9").sample(0.001, 1)).agg(F.max(F.abs(F.col("pred") - F.col("truth")))).first()[0]
    assert worst < 2e-4


def test_sampling_digest_is_md5_of_key_and_seed(spark):
    import hashlib
    df = spark.createDataFrame([("R1", 3), ("R2", 4)], "region_id string, week_idx int")
    got = [r[0] for r in df.orderBy("region_id").select(splits.hashed_share(["region_id", "week_idx"], 42)).collect()]
    assert got == [int(hashlib.md5(f"{a}|{b}|42".encode()).hexdigest()[:12], 16) % 1000 for a, b in (("R1", 3), ("R2", 4))]


def test_stored_tables_can_be_released(spark):
    from panelcast.sources import files
    df = files.store(spark.range(5), "x")
    path = files._written[-1]
    assert df.count() == 5 and files._exists(spark, path)
    keep = list(files._written)
    files._written[:] = [path]
    files.release(spark)
    assert not files._exists(spark, path)
    files._written[:] = keep[:-1]


def test_partial_autocorrelation_of_short_and_constant_arrays(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 1.0, 1.0]), (2, None)], "i int, acf array<double>")
    got = {r.i: r.p for r in df.select("i", drift.partial_autocorrelation("acf").alias("p")).collect()}
    assert got == {0: [1.0], 1: [1.0, 1.0, 0.0], 2: None}


def test_distinct_cells_give_the_errors_of_all_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(-1, 2)), int(rng.integers(1, 3)), *map(float, rng.integers(0, 3, 3))) for _ in range(500)]
    df = spark.createDataFrame(rows, "cluster_id int, horizon int, p_a double, p_b double, truth double")
    cells = blend.distinct_cells(df, ["a", "b"])
    assert cells.count() < 200
    moves = [(1, 0), (0.3, 0.7)]
    want = {r.weight_id: r for r in blend.score_weights(df, ["a", "b"], moves).collect()}
    for r in blend.score_weights(cells, ["a", "b"], moves, "times").collect():
        assert (r.macro_mae, r.cluster_mae) == pytest.approx((want[r.weight_id].macro_mae, want[r.weight_id].cluster_mae))
