"""Mixing sources to target shares of the total size.

Every record gets a hash-random key (md5 of seed and id). Within a source the records are ordered by that key in
4,096 ranges of its first digits: the sizes are summed by range first, the ranges' sums give each
range its offset, and a window inside one range of one source gives the prefix sum. So a source
that holds a third of all rows is spread over 4,096 windows. A source's records are used for whole epochs and then up to
the record whose middle reaches the rest of the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import stage


def _budgets(records: DataFrame, weights: DataFrame, total: int | None) -> DataFrame:
    """Per source its size, whole epochs and the budget of the last, partial epoch."""
    have = records.groupBy("source").agg(F.sum("size").alias("have"))
    all_ = Window.partitionBy(F.lit(0))  # one row per weighted source
    want = weights.filter("target_share > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    b = want.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    b = b.withColumn("total", F.lit(total).cast("bigint") if total is not None else F.sum("have").over(all_))
    b = b.withColumn("wanted", F.round(F.col("total") * F.col("target_share")).cast("bigint"))
    b = b.withColumn("budget", F.least("wanted", F.col("max_repeats") * F.col("have")))
    whole = F.when(F.col("have") > 0, F.expr("budget div have")).otherwise(F.lit(0))
    return b.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))


def reachable(docs: DataFrame, weights: DataFrame, text: str = "text", source: str = "source") -> int:
    """The largest total at which every source reaches its share within its ``max_repeats``; 0 where one has no text."""
    have = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(text)).alias("have"))
    want = weights.filter("target_share > 0 and source is not null").select("source", "target_share", "max_repeats")
    most = want.join(have, "source", "left").agg(F.floor(F.min(F.col("max_repeats") * F.coalesce("have", F.lit(0)) / F.col("target_share")))).first()[0]
    return int(most or 0)


def mix(docs: DataFrame, weights: DataFrame, key: str = "row_id", text: str = "text", source: str = "source", total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix (``key``, ``source``, ``epoch``, ``size``; a row for each use) and the shares that it reaches.

    Sizes are characters of ``text``, counted here, because a stored length can't be trusted. ``total`` is the size
    of the mix; without it, the size of all records that can take part. A source that runs out gives all its uses, and the
    report shows its smaller share and what it lacks (``shortfall``); the others keep their sizes, so that no source without records
    empties the mix. ``reachable`` gives the largest total without a shortfall. Null and empty texts, and sources that are null or have no weight, take no part. Records with the
    same key and size are used like any others. No record is used more than ``max_repeats`` times.
    """
    known = weights.filter("target_share > 0 and source is not null").select("source").distinct()
    records = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.length(text).cast("bigint").alias("size"), F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))).alias("h"))
    records = stage(records.filter("size > 0").join(known, "source", "left_semi"), "mix").withColumn("range", F.substring("h", 1, 3))
    budgets = _budgets(records, weights, total)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = records.groupBy("source", "range").agg(F.sum("size").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "range").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = records.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["source", "range"]).withColumn("upto", F.col("upto") + F.col("before"))
    placed = placed.join(budgets.select("source", "epochs", "rest"), "source")
    uses = (F.col("epochs") + F.when(F.col("rest") * 2 >= F.col("upto") * 2 - F.col("size"), 1).otherwise(0)).cast("int")
    mixed = placed.withColumn("uses", uses).filter("uses > 0").select("key", "source", "size", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("epoch"))
    mixed = mixed.select(F.col("key").alias(key), F.col("source").alias(source), "epoch", "size")

    reached = mixed.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("used"), F.max("epoch").alias("epochs_used"))
    all_ = Window.partitionBy(F.lit(0))
    shares = budgets.select("source", "target_share", "max_repeats", "have", "wanted", "budget").join(reached, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    shares = shares.withColumn("actual_share", F.round(F.try_divide(F.col("used").cast("double"), F.sum("used").over(all_).cast("double")), 6))
    return mixed, shares.select("source", "target_share", "actual_share", F.col("have").alias("available"), "budget", "used", (F.col("wanted") - F.col("budget")).alias("shortfall"), F.coalesce("epochs_used", F.lit(0)).alias("epochs_used"), "max_repeats")
