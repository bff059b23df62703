"""A training-data pipeline over the documents table: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.bpe import bpe_round_trip
from cloakframe.llm.decontaminate import contaminated
from cloakframe.llm.language_id import fit_languages, identify_languages
from cloakframe.llm.ngram_join import ngram_jaccard_join
from cloakframe.llm.queries import vocabulary
from cloakframe.llm.secrets import redact
from cloakframe.runtime import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or between two languages go."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("others")
    found = identify_languages(docs.select("text", others), fit_languages(docs), ("text", "others"))
    return found.where("lang_pred <> 'und' and not ambiguous").select("text", "others.*").select(*docs.columns)


def digest(docs: DataFrame) -> Column:
    """128 bits over all columns of a row; a null differs from every value, and from a null in another column."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (those without one come last).

    Different texts under one doc_id, and rows without a doc_id, are documents of their own; of rows that are equal in
    all columns one stays. Rows are numbered once, in a written table, so that no two share a number.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = ngram_jaccard_join(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__row")
    kept = rows.select("__row", "doc_id", digest(docs).alias("all")).join(found, "__row").groupBy("component_id").agg(F.min_by("__row", order).alias("__row"), F.min_by("all", order).alias("all"))
    kept = kept.groupBy("all").agg(F.min("__row").alias("__row"))  # equal rows without words are no group, but still equal
    return rows.join(kept.select("__row"), "__row").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with or without a doc_id."""
    rows = docs.withColumn("__row", digest(docs))
    found = contaminated(rows.select(F.col("__row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = written(found.select(F.col("doc_id").alias("__row")).distinct(), "contaminated", few=True)
    return rows.join(found, "__row", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to."""
    return bpe_round_trip(docs, vocabulary("byte_bpe_50k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("bpe_encode_decode", encoded),
]

#: SQL can't express the first stage; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
