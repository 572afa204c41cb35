"""Boosted trees of many targets against plain versions of their parts."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosting as bo

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 3))
    y = np.clip(1.5 + 2.0 * (x[:, 0] > 0.3) - 1.0 * (x[:, 1] > 0) * (x[:, 0] <= 0.3) + r.normal(size=1500) * 0.2, 0, 5)
    z = np.clip(2 + np.where(x[:, 2] > 0, 1.0, -1.0) + r.normal(size=1500) * 0.5, 0, 5)
    return x, y, z, r.random(1500) < 0.2


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, z, held = data
    out = []
    for i in range(len(x)):
        values = [None if i % 97 == 0 and k == 1 else float(x[i, k]) for k in range(3)]
        t = [None if held[i] else float(y[i]), None if held[i] or i % 5 == 0 else float(z[i])]
        s = [float(y[i]) if held[i] else None, float(z[i]) if held[i] else None]
        out.append((i, *values, *t, *s, 1.0, float(1 + i % 2)))
    return spark.createDataFrame(out, "i long, a double, b double, c double, y double, z double, ys double, zs double, wy double, wz double")


@pytest.fixture(scope="module")
def model(rows):
    return bo.boost(rows, COLS, ["y", "z"], ["ys", "zs"], ["wy", "wz"])


def test_errors_fall_and_boosting_stops_by_itself(model, rows, data):
    x, y, z, held = data
    got = {r.i: r.pred for r in bo.predict(model, rows, ["i"]).collect()}
    for h, truth in enumerate((y, z)):
        own = np.array([got[i][h] for i in range(len(truth))])
        w = np.ones(len(truth)) if h == 0 else 1.0 + np.arange(len(truth)) % 2
        error = np.average(np.abs(own - truth)[held], weights=w[held])
        errors = model.errors[h]
        assert error == pytest.approx(min(errors)) == pytest.approx(errors[len(model.trees[h])])
        assert len(errors) - 1 - int(np.argmin(errors)) == bo.PATIENCE
        assert error < 0.6 * np.abs(np.median(truth) - truth)[held].mean()
    gain = model.importance([1])
    assert max(gain, key=gain.get) == "c" and sum(gain.values()) == pytest.approx(1)


def test_first_leaf_is_the_weighted_median(model, data):
    _, y, _, held = data
    assert model.trees[0][0].value[0] == pytest.approx(np.median(y[~held]), abs=1 / bo.GRID)
    assert (model.trees[0][0].column == -1).all()


def test_first_split_is_the_best_of_all(model, data, rows):
    """The root of the second tree against every column and border."""
    x, y, _, held = data
    tree, first = model.trees[0][1], model.trees[0][0].value[0]
    cells = {r.i: r for r in rows.collect()}
    best = 0.0
    sign = np.sign(y - first)[~held]
    for k, c in enumerate(COLS):
        value = np.array([np.nan if cells[i][c] is None else cells[i][c] for i in np.flatnonzero(~held)])
        for at in range(len(model.cuts[k]) + 1):
            right = np.where(np.isnan(value), 0, np.searchsorted(model.cuts[k], value, "left") + 1) > at
            if bo.LEAST <= right.sum() <= len(right) - bo.LEAST:
                gain = sign[right].sum()**2 / right.sum() + sign[~right].sum()**2 / (~right).sum() - sign.sum()**2 / len(sign)
                best = max(best, gain)
    assert tree.gain[0] == pytest.approx(best)


def test_the_same_model_for_any_partitioning(rows, model):
    for parts in (3, 17):
        other = bo.boost(rows.repartition(parts, F.rand(5)), COLS, ["y", "z"], ["ys", "zs"], ["wy", "wz"])
        for a, b in zip(model.trees, other.trees):
            assert len(a) == len(b)
            assert all((s.column == t.column).all() and (s.bin == t.bin).all() and np.allclose(s.value, t.value) for s, t in zip(a, b))


def test_without_stopping_rows_and_without_rows(rows):
    m = bo.boost(rows, COLS, ["y"], most=4)
    assert len(m.trees[0]) == 4 and m.errors == [[]]
    none = bo.boost(rows.limit(0), COLS, ["y"], most=2)
    assert bo.predict(none, rows.limit(3), ["i"]).count() == 3 and bo.predict(m, rows.limit(0)).count() == 0
