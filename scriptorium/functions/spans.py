"""Markers, boundaries and token labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.classes import CJK, SPACE

MARK = "[SEP]"
IGNORED = -100
TOKEN = rf"\[SEP\]|\[CLS\]|\[PAD\]|\[UNK\]|[{CJK}]|[^{SPACE}{CJK}\[]+|\["


def insert_mark(text: Column, boundary: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), boundary), F.lit(MARK), F.substring(text, boundary + 1, F.length(text)))


def remove_marks(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(""))


def shifted(text: Column, boundary: Column) -> Column:
    """The boundary once all marks are out: five less if the first mark stands before it."""
    at = F.instr(text, MARK) - 1
    return F.when((at >= 0) & (at < boundary), boundary - len(MARK)).otherwise(boundary)


def part_lengths(text: Column) -> tuple[Column, Column]:
    """Characters before the first mark and behind it; the second is 0 without a mark."""
    parts = F.split(text, r"\[SEP\]")
    return F.length(F.element_at(parts, 1)), F.coalesce(F.length(F.try_element_at(parts, F.lit(2))), F.lit(0))


def tokens(text: Column) -> Column:
    """Special tokens, single Chinese characters and runs of other visible characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def aligned(docs: DataFrame, id: str, text: str, boundary: str) -> DataFrame:
    """One row a token: ``pos`` (from 0), ``token``, ``at`` (running characters before it) and ``token_label``.

    A token's label is 0 if its middle lies before the boundary, else 1; special tokens get -100 and no length. White space
    isn't counted. Texts without tokens and null boundaries give no rows.
    """
    each = docs.filter(F.col(boundary).isNotNull()).select(F.col(id), F.col(boundary).alias("b"), F.posexplode(tokens(F.col(text))).alias("pos", "token"))
    special = F.col("token").isin("[CLS]", "[SEP]", "[PAD]")
    size = F.when(special, 0).otherwise(F.length(F.replace("token", F.lit("##"), F.lit(""))))
    before = Window.partitionBy(id).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("size", size).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    label = F.when(special, IGNORED).when(F.col("at") + F.col("size") / 2.0 < F.col("b"), 0).otherwise(1)
    return each.select(id, "pos", "token", F.col("at").cast("bigint").alias("at"), label.alias("token_label"))


def first_transition(labels: Column) -> Column:
    """The least i >= 1 at which label i - 1 is 0 and label i is 1 (from 0), or null."""
    hits = F.filter(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: (F.element_at(labels, i) == 0) & (F.element_at(labels, i + 1) == 1))
    return F.when(F.size(labels) > 1, F.try_element_at(hits, F.lit(1)))


def padded(labels: Column, size: int = 512) -> Column:
    cut = F.slice(labels, 1, size)
    return F.concat(cut, F.array_repeat(F.lit(IGNORED), F.lit(size) - F.size(cut)))


def around(tokens_: Column, at: Column, reach: int = 3) -> Column:
    """The tokens up to ``reach`` before and behind a position (from 0)."""
    start = F.greatest(at - reach, F.lit(0))
    return F.slice(tokens_, start + 1, at + reach - start)
