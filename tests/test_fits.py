"""Fits from sums, walk-forward errors, monotone maps and dated as-of models against plain versions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import chunks
from panelcast.operators import asof, models, monotone, normal, walkforward

DIR = "/root/testdata/sf0.001"


def plain_ridge(x, y, alpha, w=None):
    """Ridge on standardised columns, from the definition."""
    w = np.ones(len(y)) if w is None else w
    mean, y0 = np.average(x, 0, w), np.average(y, weights=w)
    sd = np.sqrt(np.average((x - mean)**2, 0, w))
    sd[sd == 0] = 1
    z = (x - mean) / sd
    b = np.linalg.solve((z * w[:, None]).T @ z + alpha * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - y0)) / sd
    return b, y0 - b @ mean


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 4)) * [1, 30, 0.1, 2] + [5, 1000, 0, 0]
    y = np.stack([x @ [0.4, 0.01, 3, 0] - 10 + r.normal(size=600), x @ [0, 0.02, 0, 1] - 19 + r.normal(size=600)], 1)
    week, holes = r.integers(0, 40, 600), r.random((600, 2)) < 0.1
    rows = [(int(week[i]), *map(float, x[i]), *[None if holes[i, h] else float(y[i, h]) for h in range(2)], float(1 + i % 3)) for i in range(600)]
    rows.append((3, None, 1000.0, 0.0, 0.0, 1.0, None, 2.0))
    df = spark.createDataFrame(rows, "week_idx long, a double, b double, c double, d double, target_w1 double, target_w2 double, w double")
    full = np.array([[v if v is not None else np.nan for v in r] for r in rows])
    full[:, 1:5] = np.nan_to_num(full[:, 1:5])
    return df, full


COLS, LABELS = ["a", "b", "c", "d"], ["target_w1", "target_w2"]


@pytest.mark.parametrize("parts", [1, 7])
def test_moments_and_ridge(table, parts):
    df, full = table
    sums = normal.moments(df.repartition(parts), COLS, LABELS, weights=["w", "w"])[0]
    for subset in (None, [0, 1], [3]):
        coef, level = normal.ridge(sums, 2.0, subset)
        for h in range(2):
            use = ~np.isnan(full[:, 5 + h])
            pick = subset or [0, 1, 2, 3]
            b, c = plain_ridge(full[use][:, [1 + i for i in pick]], full[use, 5 + h], 2.0, full[use, 7])
            assert coef[h, pick] == pytest.approx(b, rel=1e-6) and level[h] == pytest.approx(c, rel=1e-6)
    assert normal.moments(df.limit(0), COLS, LABELS) == {}


def test_constant_columns_and_absent_targets():
    x = np.array([[1.0, 2.0], [1.0, 4.0], [1.0, 7.0]])
    z = np.concatenate((x, np.ones((3, 1)), [[1.0], [2.0], [3.5]]), 1)
    coef, level = normal.ridge(np.stack([z.T @ z, np.zeros((4, 4))]), 0.0)
    assert coef[0] == pytest.approx([0, 0.5]) and level[0] == pytest.approx(0) and not coef[1].any() and level[1] == 0


def test_walk_forward_equals_refits(table):
    df, full = table
    bounds = [-5, 9, 11, 30, 60]
    got = {r.boundary: r for r in walkforward.scores(df, COLS, bounds, 1.0, ["w", "w"], labels=LABELS).collect()}
    assert sorted(got) == [9, 11, 30]
    macros = []
    for b in sorted(got):
        errors, n = [], 0
        for h in range(2):
            known = ~np.isnan(full[:, 5 + h])
            fit, val = known & (full[:, 0] <= b), known & (full[:, 0] > b) & (full[:, 0] <= b + 5)
            coef, level = plain_ridge(full[fit, 1:5], full[fit, 5 + h], 1.0, full[fit, 7])
            errors.append(np.abs(np.clip(full[val, 1:5] @ coef + level, 0, 5) - full[val, 5 + h]).mean())
            n += val.sum()
        assert (got[b].mae_w1, got[b].mae_w2) == pytest.approx(tuple(errors)) and got[b].n == n
        assert got[b].macro_mae == pytest.approx(np.mean(errors))
        macros.append(np.mean(errors))
    assert all(r.avg_macro_mae == pytest.approx(np.mean(macros)) and r.last_macro_mae == pytest.approx(macros[-1]) for r in got.values())


def plain_monotone(x, y):
    """Mean rising fit by the max-min formula, at the distinct x."""
    at = sorted(set(x))
    s, w = np.array([y[x == a].sum() for a in at]), np.array([(x == a).sum() for a in at])
    return at, [max(min(s[j:k + 1].sum() / w[j:k + 1].sum() for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]


@pytest.mark.parametrize("stretch,fan,parts", [(1, 2, 3), (7, 3, 1), (100_000, 2, 17)])
def test_monotone_groups_equal_the_formula(spark, stretch, fan, parts):
    r = np.random.default_rng(2)
    data = [(k, float(round(v, 2)), float(v * (-1)**k + r.normal())) for k in (0, 2, 3) for v in r.normal(size=80) * 2]
    df = spark.createDataFrame([*data, (0, None, 1.0), (2, 1.0, None), (None, 0.5, 2.0)], "g int, pred double, truth double").repartition(parts)
    curves = monotone.curves(monotone.pools(df, ["g"], stretch=stretch, fan=fan), ["g"])
    assert set(curves) == {(0,), (2,), (3,), (None,)}
    for g in (0, 2, 3):
        x, y = (np.array([d[i] for d in data if d[0] == g]) for i in (1, 2))
        at, v = plain_monotone(x, y)
        assert np.interp(at, *curves[g,]) == pytest.approx(v)


def test_decreasing_map_and_fallbacks(spark):
    fit = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 1, 1.0, 2.0), (1, 1, 2.0, 3.0), (2, 1, 0.0, 1.0)], "c int, h int, pred double, truth double")
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 1, 9.0), (9, 1, 0.0), (9, 9, 1.25), (2, 1, None)], "c int, h int, pred double")
    got = [r.pred for r in models.calibrated(fit, rows, ["c", "h"], increasing=False).orderBy("c", "h", "pred").collect()]
    whole = (4 + 1) / 2
    assert got == [2.5, pytest.approx((4 + 2.5) / 2), None, whole, 1.25]
    assert models.calibrated(fit.limit(0), rows, ["c", "h"]).filter("pred = 9").count() == 0  # kept, within 0..5
    assert models.calibrated(fit, rows.limit(0), ["h"]).count() == 0


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("size", [1, 4, 1000])
def test_asof_join(spark, strict, size):
    r = np.random.default_rng(5)
    known = [(f"R{k}", int(t), None if r.random() < 0.2 else float(t * 10 + k)) for k in range(3) for t in sorted(r.choice(60, 20, False))]
    asked = [(f"R{int(r.integers(0, 4))}", int(r.integers(-5, 70)), i) for i in range(200)] + [("R1", None, 200)]
    a = spark.createDataFrame(asked, "region_id string, day_idx long, i long")
    b = spark.createDataFrame(known, "region_id string, day_idx long, v double")
    got = {x.i: x.found for x in chunks.asof_join(a, b, "region_id", "day_idx", "v", "found", size, strict).collect()}
    assert len(got) == len(asked)
    for k, t, i in asked:
        before = [v for kk, tt, v in known if kk == k and v is not None and t is not None and (tt < t if strict else tt <= t)]
        assert got[i] == (before[-1] if before else None)


def test_dated_models(spark):
    signals = spark.createDataFrame([("R1", d, 1.0, 2.0) for d in range(10)], "region_id string, day_idx long, s1 double, s2 double")
    fits = spark.createDataFrame([(3, "s1", 1.0), (3, "(intercept)", 0.5), (7, "s2", 2.0)], "valid_from long, term string, value double")
    got = [r.proxy for r in asof.dated_scores(signals, fits, ["s1", "s2"]).orderBy("day_idx").collect()]
    assert got == [None] * 3 + [1.5] * 4 + [4.0] * 3
    ends = spark.createDataFrame([("R1", 3), ("R1", 4), ("R1", 50)], "region_id string, window_end long")
    days = asof.dated_scores(signals, fits, ["s1", "s2"])
    assert [r.proxy for r in asof.with_dated_proxy(ends, days).orderBy("window_end").collect()] == [None, 1.5, 4.0]
