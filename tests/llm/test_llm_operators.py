"""Edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import (bpe, chaining, dart_minhash, decontamination, graph, near_vectors, resampling, samples, suffix_dedup,
                           token_files, toxicity, url_templates, words as W, wordcodes as C)

from . import brute

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, _key string, _hits int, gram string, id int, label string, _draw double"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeghilmnorstuv") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, b, passage = prose(1, 120), prose(2, 300), prose(3, 80)
    near = a.split()
    near[60] = "changed"
    return [
        (1, a), (2, a), (2, a), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (None, b), (7, b[:900] + "é" + b[900:]),
        (8, prose(4, 30) + "\n" + passage + "\n" + prose(5, 40)), (9, prose(6, 10) + " " + passage), (10, "De " * 4000), (11, "De " * 4001),
        (12, prose(7, 6000) + " 🎉 日本語 <|endoftext|> x  y \u00a0z" + "ñ" * 300), (13, "one two"), (14, "One two"), (15, "x"), (None, None),
        (16, "ñ" * 250), (17, "aé" * 150 + "ñ" * 120)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, 5, "k", 3, None, 1, "l", 0.5) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def expected(texts, values):
    return sorted(((i, *v) for (i, _), v in zip(texts, values)), key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_suffix_dedup(docs, texts, empty):
    got = rows_of(suffix_dedup.report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == expected(texts, brute.repeats([t for _, t in texts]))
    assert suffix_dedup.report(empty).count() == 0


def test_suffix_dedup_hot_grams_give_the_same(docs):
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), suffix_dedup.document_key("doc_id", "text").alias("_key"))

    def ranges(group):
        out = {}
        for r in suffix_dedup.spans(keyed, group=group).collect():
            low, high = np.array([x.low for x in r.ranges]), np.array([x.high for x in r.ranges])
            out[r.key] = [x.tolist() for x in suffix_dedup.merge_ranges(np.zeros(len(low), np.int64), low, high)]
        return out
    assert ranges(1) == ranges(100_000)


def test_suffix_cut_keeps_columns_and_characters(docs, texts, empty):
    cut = suffix_dedup.remove(docs)
    assert cut.schema.simpleString() == docs.schema.simpleString() and cut.count() == len(texts)
    assert [r.text for r in cut.filter("doc_id = 1").collect()] == [""]
    assert [r.text for r in cut.filter("doc_id = 4").collect()] == [None]
    assert suffix_dedup.remove(empty).count() == 0


def test_blind_trie_and_deep_shallow_sort_like_sorted():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(24)) for _ in range(200)]
    strings += strings[:20] + [b"a" * 20 + bytes(r.choice(b"abc") for _ in range(4)) for _ in range(100)]
    assert [strings[k] for k in suffix_dedup.blind_trie(strings)] == sorted(strings)
    order, common = suffix_dedup.deep_shallow(np.array([list(s) for s in strings], np.uint8), shallow=8)
    ranked = [strings[k] for k in order]
    assert ranked == sorted(strings)
    for a, b, n in zip(ranked, ranked[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 24 or a[n] != b[n])


def test_near_duplicates(docs, texts, empty):
    got = rows_of(dart_minhash.classes(docs), "doc_id", "class_id")
    assert got == expected(texts, [(c,) for c in brute.near_classes(texts)])
    assert dart_minhash.classes(empty).count() == 0
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    # one of: (1 2 2 3), (4 5 null) as empty, 6, b and 7, 8, 9, (10 11), 12 .. 17 each
    assert kept.count() == len(set(brute.near_classes([(k, t) for k, (_, t) in enumerate(texts)])))
    assert dart_minhash.keep_one(empty).count() == 0


def test_near_duplicates_in_a_large_bucket(spark):
    """Copies that are alike to a hub but not to each other still form one group."""
    base = prose(9, 400).split()
    rows = [(1000, " ".join(base))]
    for k in range(40):
        own = list(base)
        for j in range(8):
            own[(k * 9 + j * 47) % 400] = f"w{k}x{j}"
        rows.append((k, " ".join(own)))
    got = rows_of(dart_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id")
    assert got == expected(rows, [(c,) for c in brute.near_classes(rows)])


def test_dart_signatures_estimate_weighted_similarity():
    r = random.Random(1)
    a = [f"w{r.randint(0, 400)}" for _ in range(600)]
    b = a[:520] + [f"v{r.randint(0, 400)}" for _ in range(80)]
    column = pa.array([" ".join(a), " ".join(b), ""])
    data, offsets = W.column_bytes(column)
    regions, _, _, first = dart_minhash.shingle_units(data, offsets)
    same = dart_minhash.dart_signatures(regions, first, 2000)
    want = (lambda x, y: sum((x & y).values()) / sum((x | y).values()))(brute.shingles(" ".join(a)), brute.shingles(" ".join(b)))
    assert abs((same[0] == same[1]).mean() - want) < 0.04
    assert not same[2].any()


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000 + r.randint(0, 60), 1000 + r.randint(0, 60)) for _ in range(50)] + [(5000, 5000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = graph.components(spark.createDataFrame(links, "src long, dst long").repartition(7))
    assert {tuple(x) for x in got.collect()} == {(x, root(x)) for x in parent}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_vectors_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1),
            (7, [1.0, float("nan")], 1), (8, [1.0, float("inf")], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (11, [], 1),
            (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [1e300, 0.0], 1), (13, [1e300, 0.0], 1), (14, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, class string, links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect() if r.vec_id is not None}
    for k in (1, 2, 3, 13):
        assert got[k] == (4, 1, k == 1)
    for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 14):
        assert got[k] == (0, k, True)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((700, 48))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.925, 0.94, 700)[:, None]
    pairs = base * cos + side * np.sqrt(1 - cos * cos)
    rows = [(2 * k, base[k].tolist(), 0) for k in range(700)] + [(2 * k + 1, pairs[k].tolist(), 0) for k in range(700)]
    got = {r.vec_id: r.component_id for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = [k for k in range(700) if (base[k] @ pairs[k]) / np.linalg.norm(pairs[k]) >= 0.93]
    assert all(got[2 * k + 1] == 2 * k for k in want)
    assert all(got[2 * k + 1] == 2 * k + 1 for k in set(range(700)) - set(want))


def test_urls(spark):
    urls = ["HTTP://M.Example.COM/en/7?x", "http://example.com/en/8", "x://a.net/de/8#y", "x://example.net/de/8", "https://example.net", None, "no scheme",
            "http://é.org/es/1", "a://notexample.com/en/7", "b://com/en/", "c://h?q=/en/", "", "d://com/EN/"]
    df = spark.createDataFrame([(k, u, "r", "v") for k, u in enumerate(urls)] + [(None, "x://a.b/c", "r", "v")], "page_id long, url string, rule string, host string")
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(df, labels).collect()}
    assert got[0] == ("m.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("a.net", "/de/8", "net/de/", "allow")
    assert got[3] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[4][:3] == ("example.net", "", None)
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[11][:3] == ("", "", None)
    assert got[7] == ("é.org", "/es/1", "org/es/", "block")
    assert got[8] == ("notexample.com", "/en/7", "com/en/", "block")
    assert got[9] == ("com", "/en/", "com/en/", "block")
    assert got[10][:3] == ("h", "", None) and got[12][:3] == ("com", "/EN/", None)
    assert len(got) == 14
    assert url_templates.judge(df.limit(0), labels.limit(0)).count() == 0


def test_bad_template_is_rejected(spark):
    rows = [(k, f"http://a.b/{'spam' if k % 2 else 'news'}/{k}", k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r.verdict for r in url_templates.judge(df, df.select("page_id", "bad"), []).collect()}
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(200))


def test_decontamination(docs, texts, spark, empty):
    items = [(1, texts[9][1]), (2, "one TWO"), (3, None), (4, ""), (None, "x"), (2, "one TWO"), (5, "x"), (33, texts[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = expected(texts, brute.contamination([t for _, t in texts], items))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block_words in (2_000_000, 50):
        found = decontamination.find(docs.select("doc_id", "text"), bench, block_words=block_words)
        assert rows_of(decontamination.report(found), *names) == want
    cut = decontamination.remove(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    again = decontamination.report(decontamination.find(cut, bench))
    assert not any(r.contaminated for r in again.collect())
    assert decontamination.remove(empty, bench.limit(0)).count() == 0
    assert {tuple(r) for r in decontamination.remove(docs, bench.limit(0)).select("doc_id", "text").collect()} == set(texts)


def test_fm_index():
    r = random.Random(6)
    text = np.array([r.randint(1, 3) for _ in range(500)])
    index = decontamination.FMIndex(text, 3)
    for n in (1, 2, 5):
        phrases = np.array([text[k:k + n] for k in range(60)] + [[3] * n])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            assert sorted(index.locate(np.arange(a, b))) == [k for k in range(500 - n + 1) if (text[k:k + n] == p).all()]


def test_bpe(docs, texts, empty):
    got = rows_of(bpe.encode(docs, BYTES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == expected(texts, brute.byte_bpe([t for _, t in texts]))
    back = bpe.decode(bpe.encode(docs, BYTES, lexicon_size=10), BYTES)
    assert rows_of(back, "doc_id", "text") == expected(texts, [(t or "",) for _, t in texts])
    assert bpe.encode(empty, BYTES).count() == 0


def test_splitting_matches_the_patterns():
    r = random.Random(8)
    odd = ["".join(r.choice("ab c\n\t'slétrevmd ²\x1c½.,  ''ΣÏ\xa0́\u0085") for _ in range(30)) for _ in range(2000)] + ["", " ", "a ", "\n\n", "'"]
    vocabulary = bpe.Vocabulary(BYTES)
    data, offsets = W.column_bytes(pa.array(odd))
    begin, end, first = C.split_words(data, offsets, True)
    raw = data.tobytes()
    for k, text in enumerate(odd):
        assert [raw[a:b].decode() for a, b in zip(begin[first[k]:first[k + 1]], end[first[k]:first[k + 1]])] == vocabulary.split(text)


def test_lexicon_and_merges():
    vocabulary = bpe.Vocabulary(BYTES)
    known = sorted({w.encode() for w in prose(11, 400).split()})
    lexicon = bpe.Lexicon(bpe.Lexicon.pack(known, vocabulary.merge))
    probe = known + [w + b"x" for w in known[:50]] + [w[:-1] for w in known if w[:-1] and w[:-1] not in known][:50]
    data = np.frombuffer(b"".join(probe), np.uint8)
    length = np.array([len(w) for w in probe])
    number = lexicon.numbers(data, np.cumsum(length) - length, length)
    assert number.tolist() == list(range(len(known))) + [-1] * (len(probe) - len(known))
    ids, sizes = lexicon.find(number[:len(known)])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [vocabulary.merge(w) for w in known]
    long = (b"ab" * 400)
    assert b"".join(vocabulary.bytes[i] for i in vocabulary.merge(long)) == long


def test_token_files(docs, texts, spark, empty, tmp_path):
    folder = str(tmp_path / "ids")
    token_files.write(docs, WORDS, folder, shard_ids=500)
    got = [tuple(r) for r in token_files.read(spark, folder).orderBy("start").collect()]
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert got == brute.word_bpe(order)
    row = spark.read.parquet(folder).orderBy("part", "seq").first()
    assert len(token_files.read_document(row, 0)) == np.frombuffer(row["sizes"], "<u4")[0]
    token_files.write(empty, WORDS, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(5)
    for ids, sizes in ((np.tile([7, 8, 9, 1], 500), np.full(500, 4)), (np.full(999, 3), np.array([998, 1])), (rng.integers(0, 5, 5000), np.full(50, 100)), (np.array([1]), np.array([1]))):
        rules, lengths, sequence, symbols = token_files.compress(ids, sizes)
        assert (token_files.expand(sequence, rules) == ids).all() and symbols.sum() == len(sequence)
        own = [len(token_files.expand(np.array([token_files.BASE + k], np.uint32), rules)) for k in range(len(rules))]
        assert own == lengths.tolist()


def test_chaining(docs, texts, empty):
    got = {}
    for r in chaining.report(docs).collect():
        got.setdefault(r.doc_id, r)
    assert got[8].repeated and got[9].repeated and 9 in got[8].others and 8 in got[9].others
    assert 78 <= got[8].n_repeated <= 84
    assert got[1].n_repeated == 120 and set(got[3].others) & {1, 2} and got[3].n_repeated == 120
    assert not got[12].repeated and not got[4].repeated and got[13].n_words == 2
    assert chaining.report(docs).count() == len(texts)
    assert chaining.report(empty).count() == 0


def test_chains_follow_the_order():
    assert chaining.best_chains([0, 10, 20, 30], [0, 10, 20, 30]) == [[0, 1, 2, 3]]
    assert sorted(map(len, chaining.best_chains([0, 10, 20], [500, 10, 20]))) == [1, 2]
    assert sorted(map(len, chaining.best_chains([0, 10, 400], [0, 10, 400]))) == [1, 2]
    x = np.arange(100)
    y = np.delete(x.copy(), 40)
    assert chaining.align(x, y, [10, 60], [10, 59]) == (0, 100, 0, 99, 99)


def labelled(spark):
    good = [(k, prose(k, 60)) for k in range(120)]
    bad = [(200 + k, " ".join(w + "***" for w in prose(300 + k, 60).split())) for k in range(60)]
    rude = [(300 + k, prose(500 + k, 30) + (" grobble " if k % 2 else " Snarf, ") + prose(700 + k, 30)) for k in range(60)]
    docs = spark.createDataFrame([*good, *bad, *rude, (900, None), (901, ""), (None, "a b"), (5, prose(5, 60))], "doc_id long, text string")
    labels = [(i, int(not 200 <= i < 260), int(300 <= i < 360)) for i, _ in good + bad + rude if i % 5] + [(None, 1, 1), (3, None, 0), (901, 0, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, empty):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.kept for r in resampling.classify(docs, labels).collect()}
    assert all(got[k] for k in range(120)) and not any(got[200 + k] for k in range(60))
    assert not got[900] and not got[901] and len(got) == 243
    kept = resampling.keep(docs.withColumn("_draw", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "_draw"] and kept.filter("doc_id = 5").count() == 2
    assert resampling.classify(empty, labels).count() == 0
    assert {r.kept for r in resampling.classify(docs.filter("doc_id < 100"), labels.limit(0)).collect()} == {True}


def test_top_k_border(spark):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10).alias("_draw"))
    values = sorted((r[0] for r in df.collect()), reverse=True)
    for k in (1, 777, 19_999, 20_000):
        assert resampling.border(df, k, most=50) == values[k - 1]
    assert resampling.border(df, 0) is None and resampling.border(df.limit(0), 3) is None


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    chain = labels.selectExpr("doc_id", "1 - quality AS junk", "toxic", "quality AS p")
    got = {r.doc_id: (r.junk, r.toxic) for r in toxicity.classify(docs, chain).collect()}
    assert all(got[k] == (False, False) for k in range(120)) and all(got[200 + k][0] for k in range(60))
    assert sum(got[300 + k][1] for k in range(60)) == 60
    assert not any(got[900]) and not any(got[901])
    assert toxicity.classify(empty, chain).count() == 0
    assert not any(r.toxic for r in toxicity.classify(docs, chain.limit(0)).collect())


def test_sample_is_bounded(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert len(samples.sample(rows, ["quality"], size=100).ids) == 100


def test_pipeline_stages_on_edge_cases(docs, empty, spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (10, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, empty):
        frame = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == docs.columns, name
        assert "n_tokens" in corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).columns
