"""Deterministic sampling, balancing and splitting by hash rank.

A row's place is the order of md5(seed | id), then id: the same in any engine, on any number of partitions, and stable when other
rows come and go. Within strata the ranks are windows over (stratum, range of the hash) plus the counts of
the ranges before, so that a stratum that holds a third of all rows isn't sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 3  # leading hex digits of the hash that make a range: 4,096 of them, so ten billion rows make windows of some millions


def hash_key(id: Column | str, seed: int | str = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(id) if isinstance(id, str) else id).cast("string")))


def ranked(rows: DataFrame, id: str, strata: list[str] = [], seed: int | str = 42, name: str = "rank") -> DataFrame:  # noqa: B006
    """Adds ``rank`` (1, 2, ...) in hash order within each stratum. Null strata are strata of their own."""
    cols = [F.col(s) for s in strata]
    keyed = rows.withColumn("__h", hash_key(id, seed)).withColumn("__range", F.substring("__h", 1, RANGES))
    sid = F.to_json(F.struct(*[c.alias(f"s{i}") for i, c in enumerate(cols)])) if strata else F.lit("")
    keyed = keyed.withColumn("__s", sid)
    before = Window.partitionBy("__s").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("__s", "__range").agg(F.count("*").alias("__n"))
    offsets = counts.select("__s", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__s", "__range").orderBy("__h", id)
    out = keyed.withColumn("__r", F.row_number().over(inside)).join(offsets, ["__s", "__range"])
    return out.withColumn(name, (F.col("__r") + F.col("__first")).cast("bigint")).drop("__h", "__range", "__s", "__r", "__first")


def sample_n(rows: DataFrame, id: str, n: int, seed: int | str = 42) -> DataFrame:
    """The first ``n`` rows in hash order; all if there are fewer. A top-n, without a sort of all rows."""
    return rows.withColumn("__h", hash_key(id, seed)).orderBy("__h", id).limit(n).drop("__h")


def shuffled(rows: DataFrame, id: str, seed: int | str = 42) -> DataFrame:
    """All rows in hash order, range-partitioned."""
    return rows.withColumn("__h", hash_key(id, seed)).orderBy("__h", id).drop("__h")


def equal_strata(rows: DataFrame, id: str, label: str, bin: str, target: int, bins: int, seed: int | str = 42) -> DataFrame:
    """At most (target // 2) // bins rows of each label and bin; what a bin lacks isn't made up. Null bins are left out."""
    cap = (target // 2) // bins
    return ranked(rows.filter(F.col(bin).isNotNull()), id, [label, bin], seed).filter(F.col("rank") <= cap).drop("rank")


def weighted_strata(rows: DataFrame, id: str, length: str, edges: list[float], weights: list[float], target: Column | int, by: list[str] = [], refill: tuple[int, int] = (800, 1800), seed: int | str = 42) -> DataFrame:  # noqa: B006
    """A sample of each group whose length bins have the given weights, filled up from a middle range of lengths.

    Of each bin come min(int(target * weight), its size) rows by hash rank. What is missing comes from the group's rows not yet taken whose
    length lies in ``refill``, by hash rank, as far as there are any. ``target`` may be a column that is the same in all rows of a group.
    """
    from scriptorium.functions.maths import bin_of

    goal = target if isinstance(target, Column) else F.lit(target)
    binned = ranked(rows.withColumn("__bin", bin_of(F.col(length), edges)), id, [*by, "__bin"], seed)
    cap = F
    for i, w in enumerate(weights):
        cap = cap.when(F.col("__bin") == i, F.floor(goal * w))
    first = F.coalesce(F.col("rank") <= cap.otherwise(0), F.lit(False))
    marked = binned.withColumn("__taken", first).drop("rank")
    marked = marked.withColumn("__pool", F.when(~F.col("__taken") & (F.col(length) >= refill[0]) & (F.col(length) <= refill[1]), 1).otherwise(0))
    marked = ranked(marked, id, [*by, "__taken", "__pool"], f"{seed}-refill", "__again")
    taken = marked.groupBy(*by).agg(F.count_if("__taken").alias("__n_taken")).select(*[F.col(b).alias(f"__{b}") for b in by], "__n_taken")
    out = marked.join(taken, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]) if by else marked.crossJoin(F.broadcast(taken))  # one row
    return out.filter(F.col("__taken") | ((F.col("__pool") == 1) & (F.col("__again") <= goal - F.col("__n_taken")))).drop("__bin", "__taken", "__pool", "__again", "__n_taken", *[f"__{b}" for b in by])


def balanced(rows: DataFrame, id: str, label: str, seed: int | str = 42) -> DataFrame:
    """As many rows of each label as the rarest has. Null labels are left out."""
    known = rows.filter(F.col(label).isNotNull())
    least = known.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("__least"))
    return ranked(known, id, [label], seed).crossJoin(F.broadcast(least)).filter(F.col("rank") <= F.col("__least")).drop("rank", "__least")


def split(rows: DataFrame, id: str, strata: list[str], held: float, test: float, seed: int | str = 42) -> DataFrame:
    """Adds ``split``: of each stratum ceil(n * held) rows are held out, of these ceil(* test) are test, the rest val; all others train."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("__n")) if strata else rows.agg(F.count("*").alias("__n"))
    r = ranked(rows, id, strata, seed)
    if strata:
        sizes = sizes.select(*[F.col(s).alias(f"__{s}") for s in strata], "__n")
        on = [F.col(s).eqNullSafe(F.col(f"__{s}")) for s in strata]
        r = r.join(sizes, on).drop(*[f"__{s}" for s in strata])
    else:
        r = r.crossJoin(F.broadcast(sizes))
    out = F.ceil(F.round(F.col("__n") * held, 9))
    tested = F.ceil(F.round(out * test, 9))
    name = F.when(F.col("rank") <= tested, "test").when(F.col("rank") <= out, "val").otherwise("train")
    return r.withColumn("split", name).drop("rank", "__n")


def quota(rows: DataFrame, category: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """The first rows of each category, in ``order``, up to its quota; categories without one give none.

    Window-group-limit keeps no more than the quota of each category in any partition.
    """
    w = Window.partitionBy(category).orderBy(*order)
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    top = max(quotas.values(), default=0)
    kept = rows.filter(F.col(category).isin(*quotas)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return kept.filter(F.col("place") <= F.try_element_at(most, F.col(category)))
