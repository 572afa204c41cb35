"""Fingerprints, periodic runs and source divergence against plain versions, on edge cases and the smallest tables."""
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck
from panelcast.llm import bpe, dart_minhash, decontamination, divergence, periodic_runs, planted, scaled_sketch, token_files, words as W
from panelcast.sources.files import fresh

from . import brute as plain, brute_new as brute
from .brute import sha
from .test_llm_operators import BYTES, WORDS, docs, empty, prose, texts  # noqa: F401

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def wanted_edits(rows):
    return sorted(((i, len(a), sha(b.encode())) for i, a, b, _ in brute.edits(brute.ordered(rows))), key=str)


# fingerprints

@pytest.mark.parametrize("parts", [1, 3, 12])
def test_edited_texts(docs, texts, parts):  # noqa: F811
    got = scaled_sketch.report(scaled_sketch.beside_next(docs, partitions=parts))
    assert collected(got.select("doc_id", "n_chars", "edited_sha256")) == wanted_edits(texts)
    one = {(r.doc_id, r.n_chars): r for r in got.collect()}
    for i, a, b, after in brute.edits(brute.ordered(texts)):
        r = one[i, len(a)]
        if not brute.shingle_set(a):
            assert r.fingerprint == "" and r.near_next == float(not brute.shingle_set(after))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert one[2, len(texts[1][1])].near_next in (0.0, 1.0)


def test_edited_texts_of_one_repeated_key(spark):
    """A third of the rows with one id and text, a third without an id: each still has one follower."""
    some = [(7, "a b c d e f g")] * 40 + [(None, prose(k, 9)) for k in range(40)] + [(k, prose(k, 12)) for k in range(100, 140)]
    random.Random(1).shuffle(some)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    for parts in (1, 7):
        got = scaled_sketch.beside_next(df, partitions=parts).select("doc_id", "n_chars", "edited_sha256")
        assert collected(got) == wanted_edits(some)


def test_fingerprints_of_no_and_of_one_document(spark, empty):  # noqa: F811
    assert scaled_sketch.report(scaled_sketch.beside_next(empty)).count() == 0
    one = scaled_sketch.report(scaled_sketch.beside_next(spark.createDataFrame([(2**62 + 1, "abcd")], "doc_id long, text string"))).first()
    assert (one.doc_id, one.edited_sha256, one.near_next) == (2**62 + 1, sha(b"abab"), 1.0)


def test_fingerprints_estimate(spark, rows):
    got = {r.doc_id: r for r in entry.queries()["op11_scaled_sketch"](spark, DIR).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, a, b, after in brute.edits(brute.ordered(rows)):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), sha(b.encode()))
        x, y, z = map(brute.shingle_set, (a, b, after))
        if len(x) >= 200:
            errors += [r.near_edited - brute.alike(x, y), r.near_next - brute.alike(x, z)]
            kept = len(r.fingerprint) // 16
            assert abs(kept - len(x) / 4) < 6 * (len(x) * 3 / 16) ** 0.5 + 1
    assert np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.02


def test_sketches_are_of_the_set_of_shingles_and_merge(spark):
    a, b = prose(1, 400), prose(2, 60)
    long_ = " ".join(prose(k, 4000) for k in range(40))  # longer than a piece
    texts = [a, b, a + " " + a, "", "one", long_, "  \n", "x" * 700_000 + " y z"]  # noqa: F811
    hashes, first = scaled_sketch.sketches(pa.array(texts))
    part = [set(hashes[first[k]:first[k + 1]].tolist()) for k in range(len(texts))]
    assert [len(p) for p in part[3:5]] == [0, 1] and part[6] == set() and len(part[7]) == 1 and part[0] <= part[2]
    piece = [W.column_bytes(pa.array([t]))[0] for t in (a, long_)]
    assert set(scaled_sketch._sketch_long(piece[0], 1 / 4).tolist()) == part[0]
    starts, ends, words = W.word_spans(piece[1], np.array([0, len(piece[1])]), W.PLAIN)
    whole, _ = W.shingle_hashes(W.lane_hashes(piece[1], starts, ends), words, 5)
    assert part[5] == set(whole[whole < np.uint64(2**62)].tolist())
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    s = scaled_sketch.fingerprint(df)
    x, y = s.filter("doc_id = 0").select(F.col("sketch").alias("x")), s.filter("doc_id = 1").select(F.col("sketch").alias("y"))
    for left, right, both in ((x, y, part[0] | part[1]), (x, x.toDF("y"), part[0])):
        got = left.crossJoin(right).select(scaled_sketch.merged("x", "y").alias("m"), scaled_sketch.contained("x", "y").alias("c")).first()
        assert {v % 2**64 for v in got.m} == both


def test_merge_of_sketches_without_small_hashes(spark):
    df = spark.createDataFrame([([-5], [7 << 60], [7 << 60]), ([], [-1], [-1]), ([], [], []), ([3], [-5], [3])], "a array<long>, b array<long>, w array<long>")
    assert all(r.m == r.w for r in df.withColumn("m", scaled_sketch.merged("a", "b")).collect())


def test_word_hashes_differ_where_sums_of_powers_would_not():
    """Thue-Morse words and their complements: any polynomial modulo a power of two gives both one hash."""
    for n in (1024, 4096):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        data = np.frombuffer(bytes(97 + b for b in bits) + bytes(98 - b for b in bits), np.uint8)
        a, b = W.lane_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    data = np.frombuffer(b"abcdefghabcdefgh" + b"z" * 9000, np.uint8)
    at, to = np.array([0, 8, 0, 16, 17, 3, 3]), np.array([8, 16, 16, 9015, 9016, 3, 4])
    h = W.lane_hashes(data, at, to)
    assert h[0] == h[1] and h[3] == h[4] and len(set(h.tolist())) == 5


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_share_a_polynomial_hash(spark, n):
    """Both Thue-Morse words in one table: ids, files and hits are those of the library and of brute force."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    b = a.translate(str.maketrans("ab", "ba"))
    some = [(1, a), (2, b), (3, f"{a} x {b}"), (4, b[:-1]), (5, f"{b} y {a}")]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df, BYTES).collect()}
    for (i, _), want in zip(some, plain.byte_bpe([t for _, t in some])):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    folder = fresh(spark, "token_ids")
    token_files.write(df, WORDS, folder)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, folder).collect()) == plain.word_bpe(some)
    items = [("item b", b), ("item a", f"{a} x"), ("none", a + "c"), (None, a), ("", None)]
    found = decontamination.find(df, spark.createDataFrame(items, "item_id string, text string"), block_words=1)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.report(found).collect()}
    assert got == {i: want for (i, _), want in zip(some, plain.contamination([t for _, t in some], items))}
    assert {r.doc_id: r.class_id for r in dart_minhash.classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_strings_that_share_the_first_hash(monkeypatch):
    data = np.frombuffer(b"one two one six two", np.uint8)
    at, to = np.array([0, 4, 8, 12, 16]), np.array([3, 7, 11, 15, 19])
    want = W.distinct_strings(data, at, to)
    real = W.lane_hashes
    monkeypatch.setattr(W, "lane_hashes", lambda *a: (np.zeros(5, np.uint64), real(*a)[1]))
    got = W.distinct_strings(data, at, to)
    texts = lambda r: [data[at[r[2]][k]:to[r[2]][k]].tobytes() for k in r[3]]
    assert texts(got) == texts(want) == [b"one", b"two", b"one", b"six", b"two"] and len(got[2]) == 3


# periodic runs

def test_runs_against_all_periods():
    r = random.Random(5)
    for _ in range(300):
        rows = []  # noqa: F811
        for _ in range(r.randint(0, 4)):
            w = []
            while len(w) < r.randint(0, 60):
                w += [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(1, 6))] * r.randint(1, 7)
                w += w[:r.randint(0, 20)] * r.randint(0, 5)
            rows.append(w[:250])
        first = np.concatenate(([0], np.cumsum([len(w) for w in rows]))).astype(np.int64)
        got = periodic_runs.runs_of(np.array([x for w in rows for x in w], np.int64), first)
        assert [tuple(x) for x in got.T.tolist()] == [(k, *x) for k, w in enumerate(rows) for x in brute.runs(w)]


def test_runs_of_long_period():
    """Six copies of 3,000 different words, and a power of a power."""
    block = list(range(3000))
    ids = np.array([9999, *block * 6, 9998, *([1, 2] * 8 + [3]) * 5], np.int64)
    got = periodic_runs.runs_of(ids, np.array([0, len(ids)]))
    assert (0, 1, 18000, 3000) in {tuple(x) for x in got.T.tolist()}
    assert (0, 18002, 85, 17) in {tuple(x) for x in got.T.tolist()} and got.shape[1] == 2 + 5


def test_split_words():
    chars = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x00\x08\x85  abcé🎉"
    r = random.Random(2)
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 14))) for _ in range(2000)] + [None, "", " "]  # noqa: F811
    words, first = periodic_runs.split_words(pa.array(texts, pa.large_string()))
    words = words.to_pylist()
    import re
    assert [words[a:b] for a, b in zip(first, first[1:])] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_periodic_runs_on_edge_cases(docs, texts, empty):  # noqa: F811
    got = periodic_runs.report(periodic_runs.find(docs, before=planted.repeated)).drop("n_words")
    assert collected(got) == sorted(((i, *brute.run_report(i, t)) for i, t in texts), key=str)
    assert periodic_runs.report(periodic_runs.find(empty, before=planted.repeated)).count() == 0
    plain = periodic_runs.find(docs.withColumnRenamed("_key", "runs"), keep=("doc_id", "lang", "key")).filter("doc_id = 10").first()
    assert [tuple(x) for x in plain.runs] == [(0, 4000, 1)] and plain.collapsed == "De" and plain.key == 5


def test_periodic_runs_query(spark, rows):
    got = {r.doc_id: tuple(r)[1:8] for r in entry.queries()["op12_periodic_runs"](spark, DIR).collect()}
    assert got == {i: brute.run_report(i, t) for i, t in rows}
    assert sum(1 for v in got.values() if v[0]) >= 15


# divergence

def by_sql(spark, df):
    from panelcast.llm.oracles import DIVERGENCE
    import duckdb
    con, table = duckdb.connect(), df.toArrow()
    con.register("documents", table)
    return sorted(map(tuple, con.execute(DIVERGENCE).fetchall()), key=str)


def test_divergence_query(spark):
    ok, message = compare(spark, duck(DIR), DIR, "op13_divergence", entry.queries()["op13_divergence"], entry.oracle_sql()["op13_divergence"])
    assert ok, message


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(4)
    out = []
    vocabulary = ["a", "ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "ABCDEFGHIJ", "ñandú", "日本語", "wort", "x" * 17, "y" * 70, "y" * 71, "z"]
    for k in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 12))]
        out.append((k % 50, r.choice([" ", "7", "_", "\n"]).join(words) or None, r.choice(["de", "en", None, ""]), r.choice([None, "", "s1", "s2", "s3"])))
    out += [(500, "rare", "xx", "s1"), (501, None, "xx", None), (502, "only", "yy", "s"), (503, "t t t", "yy", "s"), (503, "t t t", "yy", "s"), (503, "t", "yy", "s")]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "_h", "rank", "sid")})


def test_divergence_on_edge_cases(spark, mixed, empty):  # noqa: F811
    got = collected(divergence.audit(mixed))
    assert got == by_sql(spark, mixed)
    assert {("xx", "", "pair", "s1", 0, 1), ("xx", "s1", "pair", "", 0, 1)} <= set(got)
    assert not divergence.audit(empty).collect()


def test_divergence_in_tiles_slices_and_with_a_full_map(spark, mixed):
    """Small tiles and slices, and a map in which most prefixes share a bit, change nothing."""
    assert collected(divergence.audit(mixed, bits=7, tile=2, slice_rows=10)) == by_sql(spark, mixed)


def test_spelling_of_a_long_text():
    long_ = "é1".join(prose(k, 3000) for k in range(150)) + " " + "w" * 3_000_000
    data = np.frombuffer(long_.encode(), np.uint8)
    a, b = divergence._spelled_long(data), divergence._spelled(data, np.array([0, len(data)]))
    assert dict(zip(a[0].to_pylist(), a[1].tolist())) == dict(zip(b[0].to_pylist(), b[1].tolist()))
