"""The registered queries over whole tables against SQL, brute force or labels."""
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck

from panelcast.sources import files

from . import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DIR}/documents.parquet").to_pylist()


def run(spark, name):
    rows = [r.asDict(recursive=True) for r in entry.queries()[name](spark, DIR).collect()]
    return rows


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("name", ["op1_near_vectors", "op2_url_templates"])
def test_against_sql(spark, name):
    ok, message = compare(spark, duck(DIR), DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_toxicity_finds_labelled_documents(spark, docs):
    got = by_id(run(spark, "op3_toxicity"))
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{DIR}/labels.parquet").to_pylist()}
    assert set(got) == {d["doc_id"] for d in docs}
    wrong = [i for i, t in labels.items() if i in got and got[i]["toxic"] != bool(t)]
    assert len(wrong) <= 0.15 * len(labels)


def test_suffix_dedup(spark, docs):
    got = by_id(run(spark, "op4_suffix_dedup"))
    for d, want in zip(docs, brute.repeats([d["text"] for d in docs])):
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want


def test_near_duplicates(spark, docs):
    got = by_id(run(spark, "op5_dart_minhash"))
    for d, want in zip(docs, brute.near_classes([(d["doc_id"], d["text"]) for d in docs])):
        assert got[d["doc_id"]]["class_id"] == want
        assert got[d["doc_id"]]["kept"] == (want == d["doc_id"])


def test_quality_keeps_good_and_drops_bad(spark):
    """On the largest tables: the smaller ones have 11 and 58 bad labels, too few to learn from."""
    larger = DIR.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r.kept for r in entry.queries()["op6_resampling"](spark, larger).collect()}
    labels = pq.read_table(f"{larger}/labels.parquet").to_pylist()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1 and r["doc_id"] in got]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0 and r["doc_id"] in got]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.05 * len(bad)


def test_decontamination(spark, docs):
    got = by_id(run(spark, "op7_decontamination"))
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DIR}/benchmark.parquet").to_pylist()]
    for d, want in zip(docs, brute.contamination([d["text"] for d in docs], items)):
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
    assert any(r["contaminated"] for r in got.values())


def test_bpe(spark, docs):
    got = by_id(run(spark, "op8_bpe"))
    for d, want in zip(docs, brute.byte_bpe([d["text"] for d in docs])):
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_token_files(spark, docs):
    got = run(spark, "op9_token_files")
    want = brute.word_bpe(sorted((d["doc_id"], d["text"]) for d in docs))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_chaining_covers_shared_passages(spark, docs):
    got = by_id(run(spark, "op10_chaining"))
    missed = total = 0
    for d, hit in zip(docs, brute.shared_words([(d["doc_id"], d["text"]) for d in docs])):
        r = got[d["doc_id"]]
        own = [False] * len(hit)
        for s in r["passages"]:
            own[s["start"]:s["stop"]] = [True] * (s["stop"] - s["start"])
        assert r["n_words"] == len(hit) and r["n_repeated"] == sum(own)
        assert r["repeated"] or not any(hit)
        total, missed = total + sum(hit), missed + sum(h and not o for h, o in zip(hit, own))
    assert missed <= 0.02 * total


def test_pipeline_stages_against_brute_force(spark, docs):
    """Each stage on what its predecessor keeps, against the plain version on the same rows."""
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "suffix_dedup", "decontaminate", "bpe"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DIR}/benchmark.parquet").to_pylist()]

    def step(name, frame):
        out = files.store(stages[name](spark, frame, DIR), name)
        return out, {r["doc_id"]: r for r in (x.asDict(recursive=True) for x in out.collect())}

    frame, kept = step("quality", spark.read.parquet(f"{DIR}/documents.parquet"))
    assert kept and frame.columns == list(docs[0]) and all(kept[d["doc_id"]] == d for d in docs if d["doc_id"] in kept)

    before = sorted((i, r["text"]) for i, r in kept.items())
    frame, one = step("near_dedup", frame)
    assert sorted(one) == sorted(set(brute.near_classes(before)))
    assert all(one[i] == kept[i] for i in one)

    frame, cut = step("suffix_dedup", frame)
    before = sorted((i, r["text"]) for i, r in one.items())
    for (i, text), (_, removed, _, digest) in zip(before, brute.repeats([t for _, t in before])):
        left = cut[i]["text"].encode()
        assert cut[i]["n_chars"] == len(cut[i]["text"])
        assert brute.sha(left) == digest or 0 < len(left) - (len(text.encode()) - removed) < 20  # whole characters stay

    frame, clean = step("decontaminate", frame)
    ids = sorted(cut)
    marks = brute.contamination([cut[i]["text"] for i in ids], items)
    assert not any(m[4] for m in brute.contamination([clean[i]["text"] for i in ids], items))
    assert all(clean[i] == cut[i] for i, m in zip(ids, marks) if not m[4])
    assert all(len(clean[i]["text"]) < len(cut[i]["text"]) for i, m in zip(ids, marks) if m[4])

    frame, tokens = step("bpe", frame)
    for i, want in zip(ids, brute.byte_bpe([clean[i]["text"] for i in ids])):
        r = tokens[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want and len(r["ids"]) == r["n_tokens"]


def test_pipeline_query_is_its_stages(spark, docs):
    rows = by_id(run(spark, "pipeline"))
    assert rows and set(rows) <= {d["doc_id"] for d in docs}
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows.values())
