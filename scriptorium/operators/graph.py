"""Statistics of a text's co-occurrence graph: words as nodes, an edge where two stand close together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.classes import SPACE

SOURCES = 4096  # words whose paths are searched together; bounds the memory of a long text


def _pieces(text: Column | str) -> Column:
    """Runs of spaces and punctuation, and the words between them: runs that begin with a letter or digit, however long.

    Scripts written without spaces aren't segmented: there a word is all that stands between two punctuation marks.
    """
    return F.split(text, rf"(?<=[^{SPACE}\p{{P}}])(?=[{SPACE}\p{{P}}])|(?<=[{SPACE}\p{{P}}])(?=[^{SPACE}\p{{P}}])")


def _is_word(piece: Column) -> Column:
    return piece.rlike(r"^[\p{L}\p{N}]")


def edges(docs: DataFrame, id: str, text: str, window: int = 50) -> DataFrame:
    """``id``, ``a`` < ``b``: distinct words that begin at most ``window`` characters apart.

    Positions are bucketed by the window; a word meets those of its own bucket and the next, so nothing beyond is paired.
    """
    words = docs.select(id, F.posexplode(_pieces(text)).alias("i", "w"))
    before = Window.partitionBy(id).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("at", F.coalesce(F.sum(F.length("w")).over(before), F.lit(0))).filter(_is_word(F.col("w")))
    words = words.select(id, F.lower("w").alias("w"), "at", F.floor(F.col("at") / window).alias("bucket")).distinct()
    near = words.select(id, F.col("w").alias("v"), F.col("at").alias("at2"), F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"))
    pairs = words.join(near, [id, "bucket"]).filter((F.col("at2") >= F.col("at")) & (F.col("at2") - F.col("at") <= window) & (F.col("w") != F.col("v")))
    return pairs.select(id, F.least("w", "v").alias("a"), F.greatest("w", "v").alias("b")).distinct()


def statistics(edge: DataFrame, id: str) -> DataFrame:
    """``nodes``, ``edges``, ``density``, ``avg_degree`` and the global ``clustering`` (3 triangles by connected triples)."""
    both = edge.select(id, "a", "b").unionByName(edge.select(id, F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(id, "a").agg(F.count("*").alias("d"))
    base = degree.groupBy(id).agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("bigint").alias("edges"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("triples"))
    x, y, z = edge.alias("x"), edge.alias("y"), edge.alias("z")
    tri = x.join(y, (F.col(f"x.{id}") == F.col(f"y.{id}")) & (F.col("x.b") == F.col("y.a"))).join(z, (F.col(f"x.{id}") == F.col(f"z.{id}")) & (F.col("x.a") == F.col("z.a")) & (F.col("y.b") == F.col("z.b")))
    tri = tri.groupBy(F.col(f"x.{id}").alias(id)).agg(F.count("*").alias("t"))
    j = base.join(tri, id, "left")
    n = F.col("nodes")
    return j.select(id, "nodes", "edges", F.round(F.try_divide(2.0 * F.col("edges"), (n * (n - 1)).cast("double")), 6).alias("density"), F.round(2.0 * F.col("edges") / n, 6).alias("avg_degree"), F.round(F.coalesce(F.try_divide(3.0 * F.coalesce("t", F.lit(0)), F.col("triples")), F.lit(0.0)), 6).alias("clustering"))


def _distances(beside: list[list[int]]) -> Counter:
    """How many ordered pairs of connected words have each distance; ``beside`` has the neighbours of each word.

    Breadth-first from SOURCES words at once, as the bits of one integer at each word, until no word is reached anew.
    """
    out: Counter = Counter()
    for first in range(0, len(beside), SOURCES):
        known = [1 << (i - first) if 0 <= i - first < SOURCES else 0 for i in range(len(beside))]
        growing = range(len(beside))
        d = 0
        while growing:
            d += 1
            last, grown = known.copy(), []
            for i in growing:
                bits = reduce(or_, map(last.__getitem__, beside[i]), last[i])
                if bits != last[i]:
                    known[i] = bits
                    out[d] += bits.bit_count() - last[i].bit_count()
                    grown.append(i)
            # What doesn't grow has all of its component, unless only some words are searched from.
            growing = grown if len(beside) <= SOURCES or not grown else growing
    return out


def _beside(a: np.ndarray, b: np.ndarray, n: int) -> list[list[int]]:
    """The neighbours of each of ``n`` words, from the edges ``a``-``b``."""
    ends, others = np.concatenate([a, b]), np.concatenate([b, a])
    stops = np.cumsum(np.bincount(ends, minlength=n)).tolist()
    others = others[np.argsort(ends, kind="stable")].tolist()
    return [others[i:j] for i, j in zip([0, *stops], stops)]


def _mean(beside: list[list[int]]) -> float | None:
    n = _distances(beside)
    return round(sum(d * k for d, k in n.items()) / n.total(), 6) if n else None


def path_lengths(edge: DataFrame, id: str) -> DataFrame:
    """Mean length of the shortest paths between all connected pairs of words, however long the paths are.

    The edges of one text come together in one task.
    """

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        words, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        a, b = np.split(at, 2)
        return pa.table({id: pa.array([key[0].as_py()], table.schema.field(id).type), "avg_path_length": pa.array([_mean(_beside(a, b, len(words)))], pa.float64())})

    ends = edge.select(id, F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    return ends.groupBy(id).applyInArrow(mean, f"`{id}` {edge.schema[id].dataType.simpleString()}, avg_path_length double")


def _linked(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct edges between the words (numbers, in order of their positions ``at``) that begin at most ``window`` apart."""
    n, i = int(words.max()) + 1, np.arange(len(at))
    near = np.searchsorted(at, at + window, side="right") - i - 1  # how many of the words after each
    x = np.repeat(words, near)
    y = words[np.arange(len(x)) - np.repeat(np.cumsum(near) - near - i - 1, near)]
    code = np.unique(np.minimum(x, y)[x != y] * n + np.maximum(x, y)[x != y])
    return code // n, code % n


def _measured(paths: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, ids, out = batch.column(1), [], []
            flat, ends = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            word, size, taken = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for k, (i, j) in enumerate(zip(ends, ends[1:])):
                if not (mine := taken[i:j]).any():
                    continue
                numbers, words = np.unique(word[i:j][mine], return_inverse=True)
                a, b = _linked(words, (np.cumsum(size[i:j]) - size[i:j])[mine], window)
                beside = _beside(a, b, len(numbers))
                if paths:
                    out.append((_mean(beside),))
                else:
                    sets = list(map(set, beside))
                    triangles = sum(len(sets[x] & sets[y]) for x, y in zip(a.tolist(), b.tolist())) // 3
                    out.append((len(numbers), len(a), sum(len(x) * (len(x) - 1) // 2 for x in beside), triangles))
                ids.append(k)
            names = ["avg_path_length"] if paths else ["nodes", "edges", "triples", "triangles"]
            columns = [pa.array(c, pa.float64() if paths else pa.int64()) for c in (zip(*out) if out else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], names=[batch.schema.names[0], *names])

    return run


def _of_texts(docs: DataFrame, id: str, text: str, window: int, paths: bool, schema: str) -> DataFrame:
    pieces = F.transform(_pieces(text), lambda p: F.struct(F.xxhash64(F.lower(p)).alias("w"), F.length(p).alias("n"), _is_word(p).alias("is_word")))
    rows = docs.filter(F.col(text).isNotNull()).select(id, pieces.alias("pieces"))
    return rows.mapInArrow(_measured(paths, window), f"`{id}` {docs.schema[id].dataType.simpleString()}, {schema}")


def text_statistics(docs: DataFrame, id: str, text: str, window: int = 50) -> DataFrame:
    """``statistics`` of each text's graph where the text is read: nothing is shuffled. Words without any edge are nodes as well.

    Texts without words (null, empty, only punctuation) give no row; each row is a text of its own, whatever its id.
    """
    n, e = F.col("nodes"), F.col("edges")
    rows = _of_texts(docs, id, text, window, False, "nodes bigint, edges bigint, triples bigint, triangles bigint")
    return rows.select(id, n, e, F.round(F.try_divide(2.0 * e, (n * (n - 1)).cast("double")), 6).alias("density"), F.round(2.0 * e / n, 6).alias("avg_degree"), F.round(F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.col("triples")), F.lit(0.0)), 6).alias("clustering"))


def text_path_lengths(docs: DataFrame, id: str, text: str, window: int = 50) -> DataFrame:
    """``path_lengths`` of each text's graph where the text is read: nothing is shuffled. Texts without an edge give no row.

    Time grows with the square of a text's distinct words, memory with its edges.
    """
    return _of_texts(docs, id, text, window, True, "avg_path_length double").filter("avg_path_length is not null")
