"""The corpus pipeline: language, repeated lines, near-duplicates, mixture and pieces, over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm import langid, linededup, mixing, neardup, pieces
from axisframe.llm.common import cut, prepare

#: Documents whose language is less likely than this go.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language and carry it in ``lang``; null and letterless texts go."""
    prepare(spark)
    labelled = langid.with_language(docs, langid.learn(docs))
    kept = labelled.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts; a document all of whose words went goes too. ``n_chars`` follows."""
    prepare(spark)
    out = linededup.dedup_lines(docs).where((F.col("n_dropped") == 0) | F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False)))
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns]
    return out.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    prepare(spark)
    return neardup.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that sources come to their target sizes; a repeated one is several rows."""
    prepare(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every row's text."""
    prepare(spark)
    return pieces.token_digests(docs, pieces.default_model(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can't express the language stage; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
