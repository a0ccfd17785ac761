"""Filling containers of fixed capacity with items of varying size.

Only the histogram of sizes, at most one class per unit of capacity however many rows there are, is gathered
on the driver. There a configuration linear program (how many containers of which filling) is
solved by multiplicative weights: each size class has a price that falls as it gets covered, and a
knapsack dynamic program over the capacity finds, for every size, the dearest filling that holds
it. The solution is rounded down, what is left over is packed best fit first, and the plan, again over
size classes, is applied to the rows: an item's place is its rank within its size, and that rank is
a distributed prefix count over hash buckets, so that a size held by a third of all rows is no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import bpe
from scriptorium.session import stage

Filling = tuple[tuple[int, int], ...]  # (size, how many), largest first


def _knapsack(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: dearest filling of c units; take[c]: index of a size in it, or -1 to leave a unit empty."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        top, at = best[c - 1], -1
        if fits[c]:
            value = best[c - sizes[: fits[c]]] + price[: fits[c]]
            k = int(value.argmax())
            if value[k] > top:
                top, at = value[k], k
        best[c], take[c] = top, at
    return best, take


def solve(histogram: dict[int, int], capacity: int, rounds: int = 160, eta: float = 0.5, gap: float = 0.001) -> tuple[list[tuple[Filling, int]], float]:
    """Fillings with the number of containers that get each, and a lower bound on the number of containers.

    ``histogram``: items by size, all sizes in 1..capacity. ``rounds`` bounds the pricing rounds; after 10, 20, 40, ... of them the solution is
    rounded, the best one is kept, and there are no more once it is within ``gap`` of the bound.
    """
    if not histogram:
        return [], 0.0
    sizes = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[s] for s in sizes.tolist()], dtype=float)
    covered, amount, bound = np.zeros(len(sizes)), Counter(), float((sizes * need).sum()) / capacity
    top: list[tuple[Filling, int]] | None = None
    check = 10
    for done in range(1, rounds + 1):
        weight = np.exp(-eta * (covered - covered.min()) * np.log(len(sizes) + 2))
        price = weight / need
        best, take = _knapsack(sizes, price, capacity)
        bound = max(bound, float((price * need).sum() / best[capacity]))
        # The dearest filling that holds a given size, for the sizes where it is within 10 % of the dearest of all.
        worth = price + best[capacity - sizes]
        chosen = np.flatnonzero(worth >= 0.9 * best[capacity])
        chosen = chosen[np.argsort(covered[chosen], kind="stable")][:96]
        gain = np.zeros(len(sizes))
        for k in chosen.tolist():
            got, c = Counter({k: 1}), capacity - int(sizes[k])
            while c > 0:
                if take[c] < 0:
                    c -= 1
                else:
                    got[int(take[c])] += 1
                    c -= int(sizes[take[c]])
            step = 0.25 * min(need[i] / n for i, n in got.items())
            amount[tuple(sorted(got.items(), reverse=True))] += step
            for i, n in got.items():
                gain[i] += step * n / need[i]
        covered += gain
        if done == check or done == rounds:
            check *= 2
            plan = _rounded(amount, sizes, need, 1 / max(covered.mean(), 1e-9), capacity)
            if top is None or _containers(plan) < _containers(top):
                top = plan
            if _containers(top) <= np.ceil(bound - 1e-6) * (1 + gap) + 1:
                break
    return top or [], bound


def _containers(plan: list[tuple[Filling, int]]) -> int:
    return sum(n for _, n in plan)


def _rounded(amount: Counter, sizes: np.ndarray, need: np.ndarray, scale: float, capacity: int) -> list[tuple[Filling, int]]:
    """The fractional solution, scaled to cover, rounded down; what is left over is packed best fit."""
    left, plan = need.astype(np.int64).copy(), []
    for config, x in sorted(amount.items(), key=lambda e: (-e[1], e[0])):
        n = min(int(x * scale), *(int(left[i]) // m for i, m in config))
        if n > 0:
            plan.append((tuple((int(sizes[i]), m) for i, m in config), n))
            for i, m in config:
                left[i] -= n * m
    return plan + _best_fit({int(s): int(n) for s, n in zip(sizes, left) if n}, capacity)


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit, largest first, over size classes; equal containers are handled together."""
    open_: dict[int, Counter] = {}  # free space -> fillings with their number
    free = np.zeros(capacity + 1, dtype=np.int64)
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            fit = np.flatnonzero(free[size:])
            if len(fit):
                room = int(fit[0]) + size
                filling, have = next(iter(open_[room].items()))
                each = min(room // size, n)  # as many as fit into one container
                used = min(have, n // each)
                open_[room][filling] -= used
                if not open_[room][filling]:
                    del open_[room][filling]
                free[room] -= used
            else:
                filling, room = (), capacity
                each = min(capacity // size, n)
                used = n // each
            rest = room - each * size
            open_.setdefault(rest, Counter())[(*filling, (size, each))] += used
            free[rest] += used
            n -= used * each
    return [(filling, n) for fillings in open_.values() for filling, n in fillings.items()]


def _ranks(items: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each size; no window is larger than a size's share of one hash bucket."""
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("size", "bucket").agg(F.count("*").alias("n")).select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("size", "bucket").orderBy("key", "piece")
    return items.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("first"))


def pack(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY, rows_per_bucket: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Assigns every text, measured in tokens, to a container.

    Returns the assignment (``key``, ``piece``, ``n_tokens``, ``container``) and one row about it. A text of more than
    ``capacity`` tokens becomes full pieces of ``capacity`` and a rest; no other is divided. Null and empty
    texts have no tokens and come out with a null container. Repeated keys are items of their own. An
    empty table gives no rows.
    """
    counted = bpe.count(docs, key, text, vocabulary).select(F.col(key).alias("key"), F.col("n_tokens"))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("int"))
    items = counted.select("key", "n_tokens", F.explode(pieces).alias("piece"))
    items = items.select("key", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece").cast("bigint") * capacity).cast("int").alias("size"))
    items = stage(items, "items")
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    empty = histogram.pop(0, 0)
    plan, bound = solve(histogram, capacity)

    # Where the items of a size go, by rank: from each start on, `each` to a container, the first of which is `first`.
    taken, container, rows = Counter(), 0, []
    for filling, n in plan:
        for size, each in filling:
            rows.append((size, taken[size], container, each))
            taken[size] += n * each
        container += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    starts = table[:, 0] * (1 << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            at = np.searchsorted(starts, size * (1 << 44) + rank, side="right") - 1
            to = table[at, 2] + (rank - table[at, 1]) // table[at, 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(to)], names=["key", "piece", "n_tokens", "container"])

    total = sum(s * n for s, n in histogram.items())
    count = sum(histogram.values())
    kind = docs.schema[key].dataType.simpleString()
    placed = _ranks(items.filter("size > 0"), max(1, count // rows_per_bucket)).select("key", "piece", "size", "rank").mapInArrow(place, f"key {kind}, piece int, n_tokens bigint, container bigint")
    without = items.filter("size = 0").select("key", "piece", F.col("size").cast("bigint").alias("n_tokens"), F.lit(None).cast("bigint").alias("container"))
    about = docs.sparkSession.createDataFrame(
        [(count, empty, container, total, total / (container * capacity) if container else None, int(np.ceil(bound - 1e-6)))],
        "items bigint, empty_items bigint, containers bigint, tokens bigint, fill double, lower_bound bigint",
    )
    return placed.unionByName(without).withColumnRenamed("key", key), about


def audit(packed: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """One row for each unique ``key`` of a packing: ``in_order`` (its pieces are 0, 1, ...), ``divided_right`` (all but the last are full) and ``fits`` (no container of its pieces is over the capacity).

    The containers' loads are summed before they are joined; a container holds ``capacity`` items at most.
    """
    loads = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("load"))
    each = packed.join(loads, "container", "left")
    full = F.count_if(F.col("n_tokens") == capacity) >= F.count("*") - 1
    return each.groupBy(key).agg((F.max("piece") == F.count("*") - 1).alias("in_order"), full.alias("divided_right"), F.bool_and(F.coalesce(F.col("load") <= capacity, F.col("n_tokens") == 0)).alias("fits"))
