"""What two texts' content has in common: letters and digits in runs of five.

Shared by the cross-split and the near-duplicate operators. The content of a text is its letters and digits in
lower case; its runs are the distinct sequences of five consecutive characters of that. Texts
of equal content form a class, represented by its least id, so that copies are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import release, stage

RUN = 5
#: Ids up to this number (16 MB) are broadcast to preselect rows; beyond it the rows are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def content(text: str) -> Column:
    """Letters and digits of a column, in lower case and in order."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and where each begins (n + 1 offsets)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))]).astype(np.int64)


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` code points from each position on; the last positions have none."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    wide = data.astype(np.uint64)
    for i in range(width):
        h += (wide[i : i + n] + np.uint64(i + 1)) * _MULTIPLIERS[i % 8]
        h ^= h >> np.uint64(29)
        h *= _MULTIPLIERS[(i + 3) % 8]
    return h ^ (h >> np.uint64(32))


def runs(text: str) -> np.ndarray:
    """Hashes of the distinct runs of one content, in ascending order."""
    return np.unique(windows(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), RUN))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def classes(rows: DataFrame) -> DataFrame:
    """``id`` and ``cls`` (least id of equal content) of ``rows`` (``id``, ``hash``).

    The least ids are found with partial aggregation, and a content that a third of all rows share has one row on the
    other side of the join, whose large partition adaptive execution splits.
    """
    least = rows.groupBy("hash").agg(F.min("id").alias("cls"))
    return rows.select("id", "hash").join(least, "hash").select("id", "cls").distinct()


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among ``ids`` (distinct, column ``id``).

    The ids are counted: up to BROADCAST_IDS of them are broadcast, more are joined by a shuffle.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def within(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of rows (``id_a`` < ``id_b``) for pairs of classes (``a``, ``b``) and membership (``id``, ``cls``)."""
    left = members.select(F.col("cls").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    each = pairs.select("a", "b").join(left, "a").join(right, "b")
    return each.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def verify(pairs: DataFrame, least: float) -> DataFrame:
    """``pairs`` (``a``, ``b``, ``text_a``, ``text_b``) of at least that exact similarity, as ``a``, ``b``, ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known: dict[int, np.ndarray] = {}
            scores = []
            for x, y, s, t in zip(a, b, batch.column(2), batch.column(3)):
                for key, text in ((x, s), (y, t)):
                    if key not in known:
                        known[key] = runs(text.as_py())
                scores.append(similarity(known[x], known[y]))
            keep = np.array(scores) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(np.array(scores)[keep], pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def components(links: DataFrame, name: str) -> DataFrame:
    """``id`` and ``component`` (its least id) of every id in ``links`` (``a``, ``b``).

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared
    folder, and only two numbers about it come to the driver. A star's neighbours are never gathered:
    each step is an aggregation of a minimum and a join by key.
    """

    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        before, edges = edges, stage(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct(), name)
        release(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    found = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = found.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    return found.unionByName(roots)
