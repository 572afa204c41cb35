"""Chunked windows, ranks, calendar and scalars against brute force on small tables."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions import blocks, calendar as cal, chunks, ranks, scalars


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for r, n in (("R1", 230), ("R2", 37), ("R3", 3)):
        x = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 50, n) * 1.5)
        rows += [(r, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "region_id string, day_idx long, x double"), pd.DataFrame(rows, columns=["r", "i", "x"])


@pytest.mark.parametrize("size", [16, 64, 4096])
def test_rolling_stats_match_brute_force(series, size):
    df, pdf = series
    wanted = {f"{s}{w}": ("x", s, w) for w in (7, 14, 21, 91) for s in ("mean", "std", "sum", "min", "max", "rows")}
    wanted.update({f"p95{w}": ("x", "p95", w) for w in (7, 14, 21)})
    got = {(r.region_id, r.day_idx): r for r in blocks.rolling_stats(df, wanted, size=size).collect()}
    assert len(got) == len(pdf)
    for r, g in pdf.groupby("r"):
        x = g.x.to_numpy(dtype=float)
        for i in range(len(x)):
            row = got[(r, i)]
            for name, (_, s, w) in wanted.items():
                tail = x[max(0, i - w + 1):i + 1]
                ok = tail[~np.isnan(tail)]
                want = {"rows": len(tail), "sum": ok.sum()}.get(s)
                if want is None:
                    want = None if not len(ok) else {"mean": ok.mean(), "std": ok.std(), "min": ok.min(),
                                                     "max": ok.max(), "p95": np.percentile(ok, 95)}[s]
                assert (row[name] is None) == (want is None), (name, i)
                if want is not None:
                    assert row[name] == pytest.approx(want, abs=1e-9)


def test_rolling_slopes_match_polyfit(series):
    df, pdf = series
    got = {(r.region_id, r.day_idx): r for r in blocks.rolling_slopes(df, {"s7": ("x", 7), "s21": ("x", 21)}, size=16).collect()}
    x = pdf[pdf.r == "R1"].x.to_numpy(dtype=float)
    for i in range(len(x)):
        for name, w in (("s7", 7), ("s21", 21)):
            tail = x[max(0, i - w + 1):i + 1]
            at = np.where(~np.isnan(tail))[0]
            want = np.polyfit(at, tail[at], 1)[0] if len(at) > 2 else 0.0
            assert got[("R1", i)][name] == pytest.approx(want, abs=1e-8)


def test_position_and_last_seen_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(3)
    days = np.sort(rng.choice(5000, 400, replace=False))
    rows = [("R1", int(d), float(v) if v > 0.7 else None) for d, v in zip(days, rng.random(400))] + [("R2", 7, 1.0)]
    df = spark.createDataFrame(rows, "region_id string, day_idx long, v double")
    out = {r.day_idx: r.p for r in chunks.with_position(df, "region_id", "day_idx", "p", 128).collect() if r.region_id == "R1"}
    assert [out[int(d)] for d in days] == list(range(400))
    seen = {r.day_idx: r.l for r in chunks.with_last_seen(df, "region_id", "day_idx", "v", "l", 128).collect() if r.region_id == "R1"}
    last = None
    for _, d, v in rows[:-1]:
        last = v if v is not None else last
        assert seen[d] == last


def test_running_sum(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in chunks.with_running_sum(df, "id", "v", "s", 64).collect()}
    want = np.concatenate([[0], np.cumsum(np.arange(1000) % 7)[:-1]])
    assert [got[i] for i in range(1000)] == list(want)


@pytest.mark.parametrize("buckets", [1, 2, 9, 200])
def test_exact_quantiles_with_a_hot_value(spark, buckets):
    rng = np.random.default_rng(5)
    a = np.concatenate([np.full(400, 3.25), rng.normal(0, 10, 800)])
    g = rng.integers(0, 3, len(a))
    df = spark.createDataFrame([(int(k), float(v), None if i % 9 == 0 else float(-v)) for i, (k, v) in enumerate(zip(g, a))],
                               "g int, a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    cut = ranks.bucket_borders(df, ["a", "b"], buckets)
    got = {(r.channel, r.q): r.value for r in ranks.exact_quantiles(df, ["a", "b"], probs, borders=cut).collect()}
    b = np.array([-v for i, v in enumerate(a) if i % 9])
    for i, p in enumerate(probs):
        assert got[("a", i)] == pytest.approx(np.quantile(a, p))
        assert got[("b", i)] == pytest.approx(np.quantile(b, p))
    by = {(r.g, r.q): r.value for r in ranks.exact_quantiles(df, ["a"], probs, by=["g"], borders=cut).collect()}
    for k in range(3):
        for i, p in enumerate(probs):
            assert by[(k, i)] == pytest.approx(np.quantile(a[g == k], p))
    grid = {r.q: r.value for r in ranks.exact_quantile_grid(df, ["a"], 1000, borders=cut).collect()}
    assert len(grid) == 1000
    assert [grid[i] for i in range(1000)] == pytest.approx(list(np.quantile(a, np.linspace(0, 1, 1000))))


def test_grid_of_a_short_column(spark):
    df = spark.createDataFrame([(1.0,), (5.0,)], "a double")
    grid = {r.q: r.value for r in ranks.exact_quantile_grid(df, ["a"], 5).collect()}
    assert [grid[i] for i in range(5)] == pytest.approx([1, 2, 3, 4, 5])


def test_odd_calendar(spark):
    dates = ["3005-02-28", "3005-02-29", "3005-03-01", "9999-12-31", "10000-01-01", "2004/2/9T10:00", "2004.02.09 10:00", "x"]
    df = cal.with_calendar(spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, date string").filter("date <> 'x'"))
    r = {x.i: x for x in df.collect()}
    assert [r[i].ord for i in range(3)] == [r[0].ord, r[0].ord + 1, r[0].ord + 2]
    assert r[4].ord == r[3].ord + 1 and r[4].gord == r[3].gord + 1
    assert r[1].doy == r[2].doy == 60          # the 365-day calendar collides, the 366-day one does not
    assert r[1].doy366 == 60 and r[2].doy366 == 61
    assert (r[5].year, r[5].month, r[5].day) == (r[6].year, r[6].month, r[6].day) == (2004, 2, 9)
    bad = spark.createDataFrame([("x",), (None,)], "date string").select(cal.gregorian_ordinal(*cal.date_parts(F.col("date"))).alias("g"))
    assert [x.g for x in bad.collect()] == [0, 0]


def test_scalars(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (7.0,), (2.5,)], "x double")
    once = df.select(scalars.clip_score(F.col("x")).alias("x"))
    assert [r.x for r in once.collect()] == [None, 0.0, 5.0, 2.5]
    assert once.select(scalars.clip_score(F.col("x")).alias("x")).collect() == once.collect()
    with pytest.raises(ValueError):
        scalars.transform_named("cube", F.col("x"))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert flat.agg(scalars.corr("a", "b")).first()[0] is None


def test_dense_index(spark):
    ids = [f"R{i}" for i in (5, 10, 2, 33, 100, 7)]
    got = {r.region_id: r.region_index for r in cal.dense_index(spark.createDataFrame([(i,) for i in ids] * 2, "region_id string")).collect()}
    assert got == {k: i for i, k in enumerate(sorted(ids))}


def test_only_wanted_buckets_reach_the_second_shuffle(spark):
    from panelcast.functions import ranks
    df = spark.range(20_000).selectExpr("'R1' AS region_id", "CAST(id * 7919 % 20011 AS double) AS x")
    borders = ranks.bucket_borders(df, ["x"], 200)
    assert 190 <= len(borders["x"]) <= 199
    rows = ranks._long(df, ["region_id"], ["x"]).withColumn("_b", ranks._bucket(borders))
    wanted = rows.filter("v < 20").select("region_id", "channel", "_b").distinct()
    assert ranks.wanted_values(rows, wanted, ["region_id", "channel", "_b"]).count() < 400
    got = {r.q: r.value for r in ranks.exact_quantiles(df, ["x"], [0.01, 0.5, 0.99], borders=borders).collect()}
    values = np.sort([k * 7919 % 20011 for k in range(20_000)])
    assert [got[q] for q in range(3)] == pytest.approx([np.quantile(values, p) for p in (0.01, 0.5, 0.99)])
