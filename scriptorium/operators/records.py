"""Hybrid records from given parts: categories, boundaries and nested spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,label:string>>"


def content_id(text: Column) -> Column:
    """The first twelve digits of the md5."""
    return F.substring(F.md5(text), 1, 12)


def _span(start: Column, end: Column, label: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(label).alias("label"))


def gated(rows: DataFrame, text: str = "text", low: int = 50, high: int | None = None) -> DataFrame:
    """Texts longer than ``low``, and no longer than ``high``."""
    kept = rows.filter(F.length(text) > low)
    return kept.filter(F.length(text) <= high) if high else kept


def generator(rows: DataFrame, category: str, low: int, high: int | None, least: int, quota: int) -> DataFrame:
    """What a generator of a category keeps of its calls (``id``, ``given``, ``made``, for continuations ``cut``), in order of ``id`` until its quota is full.

    The given text has at least ``low`` and at most ``high`` characters, what was made more than ``least``. With ``cut`` the record is
    the given text up to there and what was made, with the boundary between; without, it is what was made.
    """
    n = F.length("given")
    gate = (n >= low) & (F.length("made") > least) & (n <= high if high else F.lit(True))
    head = F.substring(F.col("given"), F.lit(1), F.col("cut")) if "cut" in rows.columns else None
    whole, boundary = (F.concat(head, F.col("made")), F.length(head)) if head is not None else (F.col("made"), F.lit(None).cast("int"))
    kept = rows.filter(gate).select("id", whole.alias("text"), boundary.alias("boundary")).orderBy("id").limit(quota)
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")))  # the quota at most
    return placed.select(F.lit(category).alias("category"), "id", content_id(F.col("text")).alias("text_id"), "text", "boundary", "place")


def record(category: str, text: Column, label: int, span_label: str, **extra: Column) -> list[Column]:
    return [content_id(text).alias("text_id"), text.alias("text"), F.lit(category).alias("category"), F.lit(label).alias("label"), F.array(_span(F.lit(0), F.length(text), span_label)).alias("spans"), *[c.alias(k) for k, c in extra.items()]]


def pure(rows: DataFrame, text: str = "text") -> DataFrame:
    return gated(rows, text, 50).select(*record("C1", F.col(text), 1, "AI", boundary=F.lit(None).cast("int")))


def continued(rows: DataFrame, human: str, cut: Column, ai: str) -> DataFrame:
    """A human beginning of ``cut`` characters with an AI continuation of more than 30; the boundary lies between."""
    head = F.substring(F.col(human), F.lit(1), cut)
    whole = F.concat(head, F.col(ai))
    spans = F.array(_span(F.lit(0), F.length(head), "Human"), _span(F.length(head), F.length(whole), "AI"))
    return rows.filter(F.length(ai) > 30).select(content_id(whole).alias("text_id"), whole.alias("text"), F.lit("C2").alias("category"), F.lit(1).alias("label"), spans.alias("spans"), F.length(head).alias("boundary"))


def edited(rows: DataFrame, text: str = "text") -> DataFrame:
    return gated(rows, text, 50).select(*record("C3", F.col(text), 1, "Mixed", boundary=F.lit(None).cast("int")))


def polished(rows: DataFrame, text: str = "text") -> DataFrame:
    return gated(rows, text, 50).select(*record("C4", F.col(text), 1, "Polished", boundary=F.lit(None).cast("int")))


def human(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.filter(F.col(text).isNotNull()).select(*record("Human", F.col(text), 0, "Human", boundary=F.lit(None).cast("int")))
