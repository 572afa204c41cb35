"""Windows by reference, rank correlation of continuous targets, the feature cache, and what the panel leaves out."""
import os
import threading
import time
from datetime import date

import numpy as np
import pytest

from panelcast.operators import checks, drift, sequences
from panelcast.sources import files
from panelcast.sources.panel import between_days


@pytest.mark.parametrize("weeks_of", [{"R1": 700, "R2": 3, "R3": 1}])
def test_place_means_equal_windows_written_out(spark, weeks_of):
    rng = np.random.default_rng(3)
    rows = [(r, w, None if rng.random() < 0.1 else float(rng.normal()), float(w)) for r, n in weeks_of.items() for w in range(n)]
    df = spark.createDataFrame(rows, "region_id string, week_idx long, x double, y double").repartition(5)
    anchors = df.filter("week_idx % 7 <> 3").select("region_id", "week_idx")
    got = {(r.region_id, r.pos): r for r in sequences.place_means(df, anchors, ["x", "y"], 40).collect()}
    assert len(got) == 40 * len(weeks_of)
    table = {(r, w): (x or 0.0, y) for r, w, x, y in rows}
    for r, n in weeks_of.items():
        at = [w for w in range(n) if w % 7 != 3]
        for p in range(40):
            places = [w - 39 + p for w in at]
            want = np.mean([table[r, max(0, q)] for q in places], axis=0)
            row = got[r, p]
            assert (row.n_anchors, row.n_padded) == (len(at), sum(q < 0 for q in places))
            assert (row.x, row.y) == pytest.approx(tuple(want))


def test_place_means_of_no_anchors(spark):
    df = spark.createDataFrame([("R1", 0, 1.0)], "region_id string, week_idx long, x double")
    assert sequences.place_means(df, df.filter("week_idx > 0"), ["x"], 5).count() == 0


def test_rank_correlation_of_a_continuous_target(spark):
    rng = np.random.default_rng(4)
    n = 4000
    y = rng.normal(size=n)
    x, flat = np.round(y + rng.normal(size=n), 1), np.ones(n)
    rows = [(float(a) if i % 9 else None, float(b), float(c) if i % 11 else None) for i, (a, b, c) in enumerate(zip(x, flat, y))]
    df = spark.createDataFrame(rows, "x double, flat double, y double").repartition(7)
    got = {r.channel: r for r in drift.rank_correlation(df, ["x", "flat"], "y").collect()}

    def mean_ranks(v):
        _, place, count = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[place]
    both = np.array([(a, c) for a, _, c in rows if a is not None and c is not None])
    want = np.corrcoef(mean_ranks(both[:, 0]), mean_ranks(both[:, 1]))[0, 1]
    assert got["x"].spearman == pytest.approx(want) and got["x"].n == len(both)
    assert got["flat"].spearman is None


@pytest.fixture
def cache(spark):
    source = files.fresh(spark, "source")
    spark.range(10).write.parquet(source)
    return source, files.fresh(spark, "cache")


def test_cache_is_built_once_and_again_after_a_change(spark, cache):
    source, root = cache
    build = lambda: spark.range(5)
    assert [files.cached_table(spark, [source], {"a": 1}, build, root)[1] for _ in range(2)] == [False, True]
    assert not files.cached_table(spark, [source], {"a": 2}, build, root)[1]
    spark.range(1).write.mode("append").parquet(source)
    df, hit = files.cached_table(spark, [source], {"a": 1}, build, root)
    assert not hit and df.count() == 5


def test_two_writers_at_once_leave_one_whole_table(spark, cache):
    source, root = cache
    built, out = [], []

    def build():
        built.append(1)
        time.sleep(2)
        return spark.range(1000).repartition(4)

    def use():
        out.append(files.cached_table(spark, [source], {}, build, root))
    threads = [threading.Thread(target=use) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(out) == 3 and all(df.count() == 1000 for df, _ in out)
    assert len(built) == sum(not hit for _, hit in out) < 3
    assert not [n for n in os.listdir(root) if n.endswith(".lease") or n.startswith("_")]


def test_a_second_publication_changes_nothing(spark):
    path = f"{files.fresh(spark, 'published')}/key"
    assert files.publish(spark, lambda: spark.range(3), path)
    before = sorted(os.listdir(path))
    assert not files.publish(spark, lambda: spark.range(9), path)
    assert sorted(os.listdir(path)) == before and spark.read.parquet(path).count() == 3
    assert os.listdir(os.path.dirname(path)) == ["key"]


def test_a_rename_that_loses_the_race_is_hidden_and_removed(spark, monkeypatch):
    path = f"{files.fresh(spark, 'raced')}/key"
    place = files._place

    def build():
        # the other writer publishes between the build and the rename, unseen by the check before it
        files_ = spark.range(3)
        files_.write.parquet(path)
        return spark.range(9)
    calls = []

    class Blind:
        def __init__(self, fs):
            self.fs = fs

        def exists(self, p):
            calls.append(p)
            return False if len(calls) == 1 else self.fs.exists(p)

        def __getattr__(self, name):
            return getattr(self.fs, name)
    monkeypatch.setattr(files, "_place", lambda s, p: (Blind(place(s, p)[0]), place(s, p)[1]))
    assert not files.publish(spark, build, path)
    assert spark.read.parquet(path).count() == 3 and not [n for n in os.listdir(path) if "key" in n]


def test_a_dead_writers_lease_is_taken_over(spark, cache):
    source, root = cache
    key = files.fingerprint(spark, [source], {})
    os.makedirs(root)
    with open(f"{root}/{key}.lease", "w"):
        pass
    os.utime(f"{root}/{key}.lease", (0, 0))
    df, hit = files.cached_table(spark, [source], {}, lambda: spark.range(2), root, patience=60)
    assert not hit and df.count() == 2


def test_left_out_items(spark):
    items = spark.createDataFrame(
        [(1, date(1995, 1, 1)), (1, date(1995, 1, 2)), (2, date(2001, 11, 4)), (2, date(2001, 11, 5)), (9, date(1999, 1, 1)), (None, None)],
        "l_suppkey long, l_shipdate date")
    suppliers = spark.createDataFrame([(1,), (2,), (2,)], "s_suppkey long")
    (r,) = checks.left_out_items(items, suppliers, between_days(items)).collect()
    assert (r.n_items, r.undated_items, r.orphan_items) == (6, 3, 2)
    (r,) = checks.left_out_items(items.limit(0), suppliers, between_days(items)).collect()
    assert (r.n_items, r.undated_items, r.orphan_items) == (0, 0, 0)
