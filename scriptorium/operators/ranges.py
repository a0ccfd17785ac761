"""Order without a sort in one task: rows in ranges of a column that hold about as many rows each.

The ranges are split by sampled quantiles, so values that pile up make narrow ranges, not large ones, and the ranged rows are
written to the shared folder: whatever reads them, or reads them again after an executor is lost, sees the same ranges. Only numbers about the
ranges, as many as there are shuffle partitions, are ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import stage


def ranged(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds ``range``: rows of a lower range are not above those of a higher one in ``columns``. Nulls come first."""
    return stage(rows.repartitionByRange(*columns).withColumn("range", F.spark_partition_id()), "ranged")


def offsets(ranged_rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """For each group and range the sums over the ranges below (``before_`` and the name) and over all (``all_`` and the name)."""
    each = ranged_rows.groupBy(*by, "range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, "range", *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"before_{n}") for n in sums], *[F.sum(n).over(group).alias(f"all_{n}") for n in sums])


def joined(ranged_rows: DataFrame, sums: DataFrame, by: list[str]) -> DataFrame:
    """The rows with their range's offsets; null groups are groups."""
    named = sums.select(*[F.col(c).alias(f"__{c}") for c in [*by, "range"]], *[c for c in sums.columns if c not in by and c != "range"])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, "range"]]
    return ranged_rows.join(named, on).drop(*[f"__{c}" for c in [*by, "range"]])


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Adds 0, 1, ... in the order of a unique column."""
    r = ranged(rows, order)
    j = joined(r, offsets(r, [], count=F.lit(1)), [])
    inside = Window.partitionBy("range").orderBy(order)
    return j.withColumn(name, F.row_number().over(inside) - 1 + F.col("before_count")).drop("range", "before_count", "all_count")


def medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The exact median of each group (``median``), the mean of the two middle values of an even number; nulls don't count.

    Values are counted first; only the ranges that hold a group's middle are sorted.
    """
    counts = ranged(rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n")), "__v")
    j = joined(counts, offsets(counts, by, n=F.col("__n")), by)
    low, high = F.floor((F.col("all_n") - 1) / 2), F.floor(F.col("all_n") / 2)
    size = F.sum("__n").over(Window.partitionBy(*by, "range"))
    j = j.withColumn("__s", size).filter((F.col("before_n") <= high) & (F.col("before_n") + F.col("__s") > low))
    upto = F.col("before_n") + F.sum("__n").over(Window.partitionBy(*by, "range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("__u", upto)
    return j.groupBy(*by).agg(((F.min(F.when(F.col("__u") > low, F.col("__v"))) + F.min(F.when(F.col("__u") > high, F.col("__v")))) / 2).alias("median"))
