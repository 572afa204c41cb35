"""The linear decomposition model against a plain numpy fit."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import sequence_fit as sf

DIR = "/root/testdata/sf0.001"
LENGTH, KERNELS, CHANNELS, SIDE, H = 12, (3, 4, 5), 3, 2, 2


@pytest.fixture(scope="module")
def table():
    """(weeks, anchors): four regions of 50 weeks, with missing channels and targets, 200 anchors."""
    r = np.random.default_rng(3)
    weeks, anchors = [], []
    for k in range(4):
        x = np.cumsum(r.normal(size=(50, CHANNELS)), 0) / 3
        for t in range(50):
            weeks.append((f"R{k}", t, *[None if r.random() < 0.02 else float(v) for v in x[t]]))
            y = x[max(0, t - 6):t + 1].mean(0) @ [1.0, -0.5, 0.2] + k / 2
            y = [float(y + r.normal() * 0.3 + (6 if r.random() < 0.05 else 0)) if r.random() > 0.1 else None for _ in range(H)]
            anchors.append((f"R{k}", t, "val" if t % 7 == 0 else "train", *map(float, r.normal(size=SIDE)), *y))
    return weeks, anchors


@pytest.fixture(scope="module")
def rows(spark, table):
    cols = [f"c{i}" for i in range(CHANNELS)]
    weeks = spark.createDataFrame(table[0], "region_id string, week_idx long, " + ", ".join(f"{c} double" for c in cols))
    side, targets = [f"s{i}" for i in range(SIDE)], [f"t{i}" for i in range(H)]
    anchors = spark.createDataFrame(table[1], "region_id string, week_idx long, part string, " + ", ".join(f"{c} double" for c in [*side, *targets]))
    return sf.blocks(weeks.orderBy(F.rand(1)), anchors, cols, side, targets, LENGTH, size=16)


def plain_features(table, kernel):
    """Trend and season of each anchor's window, side columns, 1; straight from the definition."""
    weeks = {(r, t): [v if v is not None else 0.0 for v in x] for r, t, *x in table[0]}
    out = []
    for r, t, _, *rest in table[1]:
        window = np.array([weeks[r, max(0, t - LENGTH + 1 + i)] for i in range(LENGTH)])
        padded = np.concatenate((np.repeat(window[:1], (kernel - 1) // 2, 0), window, np.repeat(window[-1:], kernel // 2, 0)))
        trend = np.array([padded[i:i + kernel].mean(0) for i in range(LENGTH)])
        out.append(np.concatenate((trend.T.ravel(), (window - trend).T.ravel(), rest[:SIDE], [1.0])))
    return np.array(out)


def plain_fit(x, y, ridge, delta, rounds=400):
    """Huber loss with a ridge, by Newton steps on the weighted squares until nothing moves."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 0
    for _ in range(rounds):
        r = x @ w - y
        k = np.minimum(1, delta / np.maximum(np.abs(r), 1e-12))
        new = np.linalg.solve((x * k[:, None]).T @ x / len(y) + penalty, (x * k[:, None]).T @ y / len(y))
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


def test_blocks_hold_each_anchor_once_and_no_more_weeks_than_needed(rows, table):
    got = rows.select("region_id", F.explode("at").alias("t")).collect()
    assert sorted((r.region_id, r.t) for r in got) == sorted((a[0], a[1]) for a in table[1])
    assert rows.agg(F.max(F.size("weeks"))).first()[0] == 16 + LENGTH - 1


def test_fit_equals_a_plain_fit(rows, table):
    shape = sf.Shape(CHANNELS, LENGTH, KERNELS, SIDE, H)
    ridge, delta = 0.05, 1.0
    stored, weights, values = sf.fit(rows, shape, rounds=1, steps=150, ridge=ridge, delta=delta)
    got = {(r.region_id, r.week_idx): r.pred for r in sf.predicted(stored, shape, weights, members=True).collect()}
    anchors = table[1]
    regions, train = np.array([a[0] for a in anchors]), np.array([a[2] == "train" for a in anchors])
    for m, kernel in enumerate(KERNELS):
        x = plain_features(table, kernel)
        for h in range(H):
            y = np.array([np.nan if a[3 + SIDE + h] is None else a[3 + SIDE + h] for a in anchors])
            use = train & ~np.isnan(y)
            level = np.zeros(len(y))
            for r in set(regions):
                level[regions == r] = y[use & (regions == r)].mean()
            w = plain_fit(x[use], (y - level)[use], ridge, delta)
            r = x[use] @ w + level[use] - y[use]
            loss = np.where(np.abs(r) <= delta, r * r / 2, delta * (np.abs(r) - delta / 2)).mean() + ridge / 2 * (w[:-1]**2).sum()
            assert values[0][m * H + h] == pytest.approx(loss, abs=1e-5)
            mine = np.array([got[a[0], a[1]][m * H + h] for a in anchors])
            assert np.abs(mine - (x @ w + level)).max() < 0.02
    mean = {(r.region_id, r.week_idx): r.pred for r in sf.predicted(stored, shape, weights).collect()}
    for key, every in got.items():
        assert mean[key] == pytest.approx(np.array(every).reshape(len(KERNELS), H).mean(0))


def test_rounds_never_raise_the_objective(rows):
    shape = sf.Shape(CHANNELS, LENGTH, KERNELS, SIDE, H)
    _, _, values = sf.fit(rows, shape, rounds=3, steps=12)
    assert all((b <= a + 1e-12).all() for a, b in zip(values, values[1:]))


def test_weights_of_windows_and_of_parts_agree():
    shape = sf.Shape(2, 9, (3, 4), 1, 2)
    w = np.random.default_rng(0).normal(size=(shape.problems, shape.size))
    window = np.random.default_rng(1).normal(size=(9, 2))
    x = np.concatenate((window.ravel(), [0.7, 1.0]))
    for j in range(shape.problems):
        trend = shape.trends[j // 2] @ window
        parts = np.concatenate((trend.T.ravel(), (window - trend).T.ravel(), [0.7, 1.0]))
        assert x @ shape.combined(w)[:, j] == pytest.approx(parts @ w[j])
        gradient = np.zeros((len(x), shape.problems))
        gradient[:, j] = x
        assert shape.split_gradient(gradient)[j] == pytest.approx(parts)


def test_inputs_hold_fifteen_channels_of_260_weeks(spark):
    from panelcast.plans import load
    load()
    from panelcast.plans import models as plans
    rows = plans.decomp_blocks(spark, DIR)
    assert rows.filter("size(x) <> 15 * size(weeks) OR size(truth) <> 5 * size(at)").count() == 0
    assert plans.DECOMP_WEEKS == 260 and tuple(plans.KERNELS) == (13, 25, 101)
    assert rows.groupBy("region_id").agg(F.sum(F.size("at")).alias("n")).filter("n <> 344 - 12 - 5").count() == 0
