"""A corpus cleaned and tokenised in five stages, each written as Parquet and read again.

The first four return the columns of the documents they get; the last one row per document that is left.
"""
import public_tokenizers
from pyspark.sql import functions as F

from panelcast.llm import bpe, dart_minhash, decontamination, resampling, suffix_dedup
from panelcast.sources.files import store

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _measured(docs):
    """`n_chars` follows the text where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality(spark, docs, sf_dir):
    """Documents that the importance resampling draws."""
    return resampling.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies, the one with the least id."""
    return dart_minhash.keep_one(docs)


def suffix_dedup_stage(spark, docs, sf_dir):
    """Texts without the 200-byte strings that stand elsewhere too; a text may become empty."""
    return _measured(suffix_dedup.remove(docs))


def decontaminate(spark, docs, sf_dir):
    """Texts without the spans that benchmark items share with them."""
    return _measured(decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenize(spark, docs, sf_dir):
    """doc_id, lang, source, n_tokens, digests and token ids of each text."""
    return bpe.encode(docs, VOCABULARY, keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup_stage), ("decontaminate", decontaminate), ("bpe", tokenize)]

#: Fitted models, suffix sorting and merges aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
