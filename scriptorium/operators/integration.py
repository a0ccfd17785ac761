"""Bringing sources together: standard schema, union, exact de-duplication, quality filter, lookups and leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.classes import SPACE

def standardized(rows: DataFrame, id: str, priority: int = 0) -> DataFrame | None:
    """id, text, label (default 0), source (default 'unknown'), length, text_hash and the source's priority; None without a text."""
    if "text" not in rows.columns:
        return None
    label = F.coalesce(F.col("label").cast("int"), F.lit(0)) if "label" in rows.columns else F.lit(0)
    source = F.coalesce(F.col("source"), F.lit("unknown")) if "source" in rows.columns else F.lit("unknown")
    return rows.select(F.col(id).cast("bigint").alias("id"), "text", label.alias("label"), source.alias("source"), F.length("text").alias("length"), F.md5("text").alias("text_hash"), F.lit(priority).alias("priority"))


def union(frames: list[DataFrame | None]) -> DataFrame:
    """All rows by column name; missing columns are null, frames that are None are skipped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f for f in frames if f is not None])


def good(rows: DataFrame, low: int = 50, high: int = 5000) -> DataFrame:
    """Texts of an allowed length that aren't blank. Null texts drop."""
    return rows.filter(F.length("text").between(low, high) & F.col("text").rlike(f"[^{SPACE}]"))


def first_by_hash(rows: DataFrame, order: list[str], hash: str = "text_hash") -> DataFrame:
    """One row for each text hash: the first in ``order``, which must be total.

    ``min_by`` over a struct aggregates before the shuffle, so a text that a third of all rows share costs one row a partition. Rows
    with a null hash count as one text.
    """
    whole = F.struct(*rows.columns)
    return rows.groupBy(hash).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")


def duplicate_stats(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows, texts, distinct texts, duplicates and their rate among the rows."""
    by = rows.filter(F.col(text).isNotNull()).groupBy(F.md5(text).alias("h"), F.length(text).alias("l")).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_texts"), F.count("*").alias("n_distinct")).select(
        "n_texts", "n_distinct", (F.col("n_texts") - F.col("n_distinct")).alias("n_duplicates"), F.round(F.coalesce(F.try_divide((F.col("n_texts") - F.col("n_distinct")).cast("double"), F.col("n_texts").cast("double")), F.lit(0.0)), 6).alias("duplicate_rate")
    )


def truncated(rows: DataFrame, label: int = 1, most: int = 2500) -> DataFrame:
    """Texts of that label are cut to ``most`` characters, with their length."""
    cut = (F.col("label") == label) & (F.length("text") > most)
    return rows.withColumn("text", F.when(cut, F.substring("text", 1, most)).otherwise(F.col("text"))).withColumn("length", F.length("text"))


def looked_up(probe: DataFrame, build: DataFrame, text: str, value: str, order: str, name: str) -> DataFrame:
    """Adds to ``probe`` the last ``value`` (by ``order``) that ``build`` has for the same text; misses stay with null.

    The join is on the text's hash and on the text.
    """
    last = build.filter(F.col(text).isNotNull()).groupBy(F.md5(text).alias("__h"), F.col(text).alias("__t")).agg(F.max_by(value, order).alias(name))
    return probe.join(last, (F.md5(probe[text]) == F.col("__h")) & (probe[text] == F.col("__t")), "left").drop("__h", "__t")


def merged(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Each row with what ``others`` (one row a name) have under its name, and ``matched``; unmatched rows stay, with nulls."""
    known = others.withColumnRenamed(name, "__name")
    return rows.join(known, F.col(name) == F.col("__name"), "left").withColumn("matched", F.col("__name").isNotNull()).drop("__name")


def remaining(rows: DataFrame, taken: DataFrame, id: str) -> DataFrame:
    return rows.join(taken.select(id), id, "left_anti")


def flagged(rows: DataFrame, done: DataFrame, id: str, flag: str) -> DataFrame:
    """``flag`` is set where ``id`` is in ``done``; otherwise it stays (null as false)."""
    seen = done.select(F.col(id).alias("__id")).distinct()
    return rows.join(seen, F.col(id) == F.col("__id"), "left").withColumn(flag, F.col("__id").isNotNull() | F.coalesce(F.col(flag), F.lit(False))).drop("__id")


def leakage(parts: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """For each two parts the number of distinct texts that both have, and the rows of the second with one in the first."""
    all_ = union([df.filter(F.col(text).isNotNull()).select(F.lit(name).alias("part"), F.md5(text).alias("h")) for name, df in parts.items()])
    counts = all_.groupBy("h").pivot("part", list(parts)).agg(F.count(F.lit(1))).na.fill(0)
    names = list(parts)
    out = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    pairs = F.array(*[F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), F.when(F.col(a) > 0, F.col(b)).otherwise(0).alias("rows_b")) for a, b in out])
    return counts.select(F.explode(pairs).alias("p")).select("p.*").groupBy("part_a", "part_b").agg(F.count_if(F.col("rows_b") > 0).alias("shared_texts"), F.sum("rows_b").alias("leaked_rows"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows delivered more than once, the last of each key by ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def within_shares(rows: DataFrame, by: str) -> DataFrame:
    """Count of each value and its share of all rows."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("__total"), 6)).drop("__total")  # one row


def verdict_of_sources(rows: DataFrame, bad: str, warn: str, ok: str) -> DataFrame:
    """'rejected' if a source is among the rows that must not be, else 'warning', 'ok' or 'unknown'."""
    seen = rows.agg(F.collect_set("source").alias("s"))  # one entry for each source
    v: Column = F.when(F.array_contains("s", bad), "rejected").when(F.array_contains("s", warn), "warning").when(F.array_contains("s", ok), "ok").otherwise("unknown")
    return seen.select(F.size("s").alias("n_sources"), v.alias("verdict"))
