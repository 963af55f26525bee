"""A cleaning pipeline for training documents: language, near copies, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as a table before the
next stage reads it.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import decontaminate, jaccard_join, language_id, pii, trie_bpe
from seriesforge.llm.storage import unused, written
from seriesforge.llm.vocabulary import default_vocabulary
from seriesforge.sources.shipping import ship_package


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language more likely than all others together."""
    ship_package(spark)
    return language_id.keep_identified(docs, language_id.train(docs, ~language_id.held_out()))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the smallest id stays; of rows with one id and equal texts, any one.

    Rows of one id with different texts are documents of their own, and rows without an id all stay.
    """
    ship_package(spark)
    key, of, of_key = unused(docs, "text_key", "of", "of_key")
    rows = written(jaccard_join.link_rows(docs), "linked")
    each = rows.groupBy(F.col("doc_id").alias(of), F.col("text_key").alias(of_key)).agg(F.first("stays").alias("stays"), F.count("*").alias("rows"))
    same = (F.col("doc_id") == F.col(of)) & (F.col(key) == F.col(of_key))
    keyed = docs.withColumn(key, jaccard_join.text_key("text"))
    kept = keyed.join(written(each.where("not stays").select(of, of_key), "copies").hint("shuffle_hash"), same, "left_anti")
    repeated = written(each.where("stays and rows > 1").select(of, of_key), "repeated")
    if repeated.head(1):
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's question and answer."""
    ship_package(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and generalises terms that disclose it."""
    ship_package(spark)
    return pii.sanitise(docs, written(pii.find_spans(docs), "pii-spans"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what remains."""
    ship_package(spark)
    return trie_bpe.encode_documents(docs, default_vocabulary())


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("bpe", encode_tokens),
]

#: The stages learn a classifier, join sets and encode text, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
