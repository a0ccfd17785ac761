"""Queries by name, each with the SQL that gives the same rows, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Labelled documents with a deterministic score, in SQL; ``corpus`` is the same as a DataFrame.
CORPUS = """corpus AS (SELECT doc_id AS id, text, label, lang, source, category, boundary,
  CAST((doc_id * 7919 + 104729) % 10007 AS DOUBLE) / 10007.0::DOUBLE AS prob_ai
  FROM documents WHERE text IS NOT NULL AND label IS NOT NULL),
scored AS (SELECT *, CAST(prob_ai > 0.5 AS INT) AS pred FROM corpus)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null and label is not null")
    score = ((F.col("doc_id") * 7919 + 104729) % 10007).cast("double") / F.lit(10007.0)
    return docs.select(F.col("doc_id").alias("id"), "text", "label", "lang", "source", "category", "boundary", score.alias("prob_ai"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).withColumn("pred", (F.col("prob_ai") > 0.5).cast("int"))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def multi(pattern: str) -> str:
    """A multi-line pattern as an SQL literal."""
    return quoted("(?m)" + pattern)
