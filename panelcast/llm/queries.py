"""The registered queries of this subpackage: each operator over its whole table."""
import public_tokenizers

import corpus_pipeline
from panelcast.llm import bpe, chaining, dart_minhash, decontamination, divergence, near_vectors, oracles, periodic_runs, planted, resampling, scaled_sketch, suffix_dedup, token_files, toxicity, url_templates
from panelcast.sources.files import fresh

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


SQL["op1_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON vec_id = comp.x LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON vec_id = l.x"""


@query
def op2_url_templates(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS page_id", "1 - quality AS bad")
    return url_templates.judge(table(spark, sf_dir, "pages"), labels)


SQL["op2_url_templates"] = url_templates.oracle()


@query
def op3_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "1 - quality AS junk", "toxic")
    return toxicity.classify(table(spark, sf_dir, "documents"), labels)


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query
def op5_dart_minhash(spark, sf_dir):
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


@query
def op6_resampling(spark, sf_dir):
    return resampling.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_decontamination(spark, sf_dir):
    found = decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontamination.report(found)


@query
def op8_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query
def op9_token_files(spark, sf_dir):
    folder = fresh(spark, "token_ids")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read(spark, folder)


@query
def op10_chaining(spark, sf_dir):
    return chaining.report(table(spark, sf_dir, "documents"))


@query
def op11_scaled_sketch(spark, sf_dir):
    return scaled_sketch.report(scaled_sketch.beside_next(table(spark, sf_dir, "documents")))


@query
def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.report(periodic_runs.find(table(spark, sf_dir, "documents"), before=planted.repeated))


@query
def op13_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op13_divergence"] = oracles.DIVERGENCE
SQL["op4_suffix_dedup"] = oracles.SUFFIX_DEDUP
SQL["op5_dart_minhash"] = oracles.NEAR_DUPLICATES
SQL["op7_decontamination"] = oracles.DECONTAMINATION
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
