"""Near-duplicates across a collection too large for pairwise comparison, by a MinHash LSH forest.

Each distinct content gets a MinHash signature. There are ``trees`` tries over it, each reading the signature's values in its
own order; a record's label in a trie is a sequence of values, and the labels are kept sorted, so that records that
share a prefix are neighbours and the longest prefix that each shares with any other is read off its neighbours. The matched
prefix starts at the whole label and is shortened: the pairs verified at one depth, each weighted by how unlikely it was to be met
there, tell how many are still missing, and so whether to shorten and how far. Shortening ends where the estimated recall reaches
the target, at the latest at the floor, the depth at which even pairs at the threshold are found well enough, whatever the data. Candidates
are held against a second, independent sketch of 32 bytes, and those that may be similar enough are verified exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import content as C
from scriptorium.session import release, stage

VALUES, SKETCH = 96, 32
BELOW = 8  # values of a label below the floor, a byte each
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 31, VALUES + SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, VALUES + SKETCH, dtype=np.uint32)


@functools.cache
def chance(similarity: float, depth: int, trees: int) -> float:
    """Probability that two contents of that similarity share a prefix of that depth in some trie.

    The tries read the same values, so it is taken over how many of these agree: given that number, each trie
    reads ``depth`` different ones.
    """
    agree = np.arange(VALUES + 1)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, VALUES + 1)))])
    s = min(max(similarity, 1e-9), 1 - 1e-9)
    weight = np.exp(log[VALUES] - log[agree] - log[VALUES - agree] + agree * np.log(s) + (VALUES - agree) * np.log(1 - s))
    one = np.prod([np.maximum(agree - i, 0) / (VALUES - i) for i in range(depth)], axis=0)
    return float((weight * (1 - (1 - one) ** trees)).sum())


def floor_depth(threshold: float, trees: int, recall: float) -> int:
    """The longest prefix that even contents at the threshold share in some trie with the target's probability."""
    return max((d for d in range(1, 33) if chance(threshold, d, trees) >= recall), default=1)


def _orders(trees: int, floor: int) -> np.ndarray:
    """Which values of the signature each trie reads; down to the floor every value is read equally often."""
    rng = np.random.default_rng(7)
    rounds = -(-trees * floor // VALUES)
    while True:
        flat = np.concatenate([rng.permutation(VALUES) for _ in range(rounds)])[: trees * floor].reshape(trees, floor)
        if all(len(set(row)) == floor for row in flat.tolist()):
            break
    return np.array([np.concatenate([row, rng.permutation(np.setdiff1d(np.arange(VALUES), row))[:BELOW]]) for row in flat])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, hash, content -> id, hash, n (length of the content), signature, sketch."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        n = len(texts)
        signature, sketch = np.empty((n, VALUES), dtype=np.uint16), np.empty((n, SKETCH), dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
        a = 0
        while a < n:  # slices whose hashes stay in the processor's cache
            b, held = a, 0
            while b < n and (b == a or held + lengths[b] < 40_000):
                held += lengths[b]
                b += 1
            data, at = C.codes(texts[a:b])
            h = C.windows(data, C.RUN)
            full = np.ones(len(h), dtype=bool)
            for k in range(1, C.RUN):
                over = at[1:-1] - k
                full[over[(over >= 0) & (over < len(h))]] = False
            h = (h[full] >> np.uint64(31)).astype(np.uint32)
            first = np.concatenate([[0], np.cumsum(lengths[a:b] - C.RUN + 1)[:-1]])
            for j in range(VALUES + SKETCH):
                low = np.minimum.reduceat(h * _FACTORS[j] + _TERMS[j], first)
                low ^= low >> np.uint32(15)
                low *= np.uint32(0x2C1B3C6D)
                if j < VALUES:
                    signature[a:b, j] = low >> np.uint32(16)
                else:
                    sketch[a:b, j - VALUES] = low >> np.uint32(24)
            a = b
        kind = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (signature, sketch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths.astype(np.int32)), *kind], names=["id", "hash", "n", "signature", "sketch"])


def _rows(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A column of byte strings of equal length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _labels(trees: int, floor: int):
    """Labels of the reps (cls, signature): root (trie and values down to the floor, hashed), deep (the values below it), cls."""
    orders = _orders(trees, floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _rows(batch.column(1), VALUES, np.uint16).astype(np.uint64)
            ids = batch.column(0)
            for t in range(trees):
                root, deep = np.full(len(values), t * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64), np.zeros(len(values), dtype=np.uint64)
                for j in orders[t, :floor]:
                    root = (root ^ values[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
                    root ^= root >> np.uint64(31)
                for j in orders[t, floor:]:
                    deep = deep << np.uint64(8) | values[:, j] & np.uint64(255)
                yield pa.RecordBatch.from_arrays([pa.array(root.view(np.int64)), pa.array(deep.view(np.int64)), ids], names=["root", "deep", "cls"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted labels -> those that share a root with the one before or behind: with ``depth`` (values below the root that they share, -1 if no root), and ``edge``.

    ``edge`` is 1 for the first label of the task, 2 for the last, 3 for an only one, which stay in any case; 0 else.
    """
    task = TaskContext.get().partitionId()  # type: ignore[union-attr]
    names = ["root", "deep", "cls", "depth", "edge", "range"]
    held: list[np.ndarray] | None = None  # the last label, whose next one isn't known yet
    shared, emitted = -1, False

    def out(columns: list[np.ndarray], depth: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero((depth >= 0) | (edge > 0))
        extra = (depth[keep].astype(np.int32), edge[keep].astype(np.int32), np.full(len(keep), task, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*(c[keep] for c in columns), *extra)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        root, deep = columns[0], columns[1].view(np.uint64)
        apart = deep[:-1] ^ deep[1:]
        same = sum(((apart >> np.uint64(64 - 8 * k)) == 0).astype(np.int64) for k in range(1, BELOW + 1))
        behind = np.where(root[:-1] == root[1:], same, -1)
        before = np.concatenate([[shared], behind])
        edge = np.zeros(len(behind), dtype=np.int64)
        if len(edge) and not emitted:
            edge[0], emitted = 1, True
        yield out([c[:-1] for c in columns], np.maximum(before[:-1], behind), edge)
        held, shared = [c[-1:] for c in columns], int(before[-1])
    if held is not None:
        yield out(held, np.array([shared]), np.array([2 if emitted else 3]))


def _alike(least: int):
    """Candidates (a, b, sketch_a, sketch_b) that agree in at least so many bytes of their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_rows(batch.column(2), SKETCH, np.uint8) == _rows(batch.column(3), SKETCH, np.uint8)).sum(axis=1)
                keep = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


class Forest:
    """The sorted tries over ``docs`` (``id``, ``text``), and the candidates that they give."""

    def __init__(self, docs: DataFrame, threshold: float, trees: int, recall: float, floor_recall: float) -> None:
        self.threshold, self.trees, self.recall = threshold, trees, recall
        self.floor = floor_depth(threshold, trees, floor_recall)
        self.deepest = self.floor + BELOW
        self.texts = docs.select(F.col("id").cast("bigint").alias("id"), C.content("text").alias("content")).filter(f"id is not null and length(content) >= {C.RUN}")
        signed = stage(self.texts.select("id", F.unhex(F.md5("content")).alias("hash"), "content").mapInArrow(_sign, "id bigint, hash binary, n int, signature binary, sketch binary"), "signed")
        self.members = stage(C.classes(signed), "members")
        heads = self.members.filter("id = cls").select("id")
        self.reps = stage(signed.join(heads, "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("cls"), "signature", "sketch"), "reps")
        release(signed)
        self.tries = self._sorted(self.reps.select("cls", "signature").mapInArrow(_labels(trees, self.floor), "root bigint, deep bigint, cls bigint"))

    def _sorted(self, labels: DataFrame) -> DataFrame:
        """``root``, ``deep``, ``cls`` and ``depth``, the longest prefix that a record shares with any other in a trie, of those that share one down to the floor.

        The labels are sorted in ranges, so a subtree that a third of all records share is spread over many tasks; each
        task reads off its neighbours, and only its first and last label are compared with those of the ranges beside it.
        """
        ranged = labels.repartitionByRange("root", "deep", "cls").sortWithinPartitions("root", "deep", "cls")
        near = stage(ranged.mapInArrow(_neighbours, "root bigint, deep bigint, cls bigint, depth int, edge int, range int"), "neighbours")
        in_order = Window.partitionBy(F.lit(0)).orderBy("range", "edge")  # two rows a task
        beside = [F.when(F.col("edge").isin(*kinds) & (F.col("root") == f("root").over(in_order)), self._shared(F.col("deep"), f("deep").over(in_order))) for f, kinds in ((F.lag, (1, 3)), (F.lead, (2, 3)))]
        own = F.when(F.col("depth") >= 0, F.col("depth") + self.floor)
        edges = near.filter("edge > 0").withColumn("depth", F.greatest(own, *beside)).filter("depth is not null")
        return near.filter("edge = 0").withColumn("depth", own).unionByName(edges).select("root", "deep", "cls", "depth")

    def _shared(self, a: Column, b: Column) -> Column:
        """How many values two labels of a subtree share; null where there is no second one."""
        apart = a.bitwiseXOR(b)
        return self.floor + sum((F.shiftrightunsigned(apart, 64 - 8 * k) == 0).cast("int") for k in range(1, BELOW + 1))

    def nodes(self, depth: int) -> DataFrame:
        """``root``, ``node``, ``cls`` of the records that share a prefix of that depth with another."""
        below = depth - self.floor
        node = F.shiftrightunsigned("deep", 64 - 8 * below) if below else F.lit(0).cast("bigint")
        return self.tries.filter(F.col("depth") >= depth).select("root", node.alias("node"), "cls")

    def likely(self, met: DataFrame, tested: DataFrame | None) -> DataFrame:
        """Of the pairs ``a``, ``b`` those not tested before whose sketches agree in enough bytes."""
        met = met.distinct()
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        small = self.reps.select("cls", "sketch")
        held = met.join(small.select(F.col("cls").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(small.select(F.col("cls").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        # At a threshold of 0.6, 32 bytes agree in 19 +- 3; 8 is four deviations below.
        least = int(SKETCH * self.threshold - 4 * (SKETCH * self.threshold * (1 - self.threshold)) ** 0.5)
        return stage(held.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike(least), "a bigint, b bigint"), "likely")

    def verified(self, likely: DataFrame) -> DataFrame:
        """``a``, ``b`` and the exact ``similarity`` of the pairs that reach the threshold."""
        ids = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
        wanted = C.only(self.texts, ids).dropDuplicates(["id"])
        both = likely.join(wanted.select(F.col("id").alias("a"), F.col("content").alias("text_a")), "a").join(wanted.select(F.col("id").alias("b"), F.col("content").alias("text_b")), "b")
        return stage(C.verify(both, self.threshold), "links")

    def shorter(self, near: DataFrame, depth: int) -> int | None:
        """The depth to go on with after the pairs ``near`` met at ``depth``; None where the target recall is reached.

        A pair met with probability p stands for 1 / p pairs. One imagined pair at the threshold, not met, is added,
        so that a level with few pairs, which says little, isn't taken for a complete one.
        """
        counted = near.groupBy(F.floor(F.col("similarity") * 1000).cast("int").alias("s")).agg(F.count("*").alias("n")).collect()  # 1,001 rows at most
        pairs = [((r["s"] + 0.5) / 1000, r["n"] / chance((r["s"] + 0.5) / 1000, depth, self.trees), r["n"]) for r in counted]
        extra = 1 / chance(self.threshold, depth, self.trees)
        total = extra + sum(w for _, w, _ in pairs)
        if depth == self.floor or sum(n for *_, n in pairs) / total >= self.recall:
            return None
        expected = {d: (extra * chance(self.threshold, d, self.trees) + sum(w * chance(s, d, self.trees) for s, w, _ in pairs)) / total for d in range(self.floor, depth)}
        return max((d for d, part in expected.items() if part >= self.recall), default=self.floor)


def _pairs(nodes: DataFrame) -> DataFrame:
    x, y = nodes.alias("x"), nodes.alias("y")
    same = (F.col("x.root") == F.col("y.root")) & (F.col("x.node") == F.col("y.node")) & (F.col("x.cls") < F.col("y.cls"))
    return x.join(y, same).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def links(docs: DataFrame, threshold: float = 0.6, trees: int = 48, recall: float = 0.999, floor_recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Similar classes (``a`` < ``b``, ``similarity``) and the membership (``id``, ``cls``) of ``docs`` (``id``, ``text``).

    A class is the ids of equal content, named by the least. Texts whose content is shorter than a run (null, blank,
    tiny) belong to no class; null ids are left out; a repeated id counts once; an empty table has no links.
    ``recall`` is the part of all links that is to be found, as estimated from those verified, and ``floor_recall`` the
    part of those right at the threshold; prefixes are shortened until either is reached.
    """
    forest = Forest(docs, threshold, trees, recall, floor_recall)
    depth: int | None = forest.deepest
    near = tested = None
    while depth is not None:
        new = forest.likely(_pairs(forest.nodes(depth)), tested)
        found_ = forest.verified(new)
        near, tested = (found_, new) if near is None else (near.unionByName(found_), tested.unionByName(new))
        depth = forest.shorter(near, depth)
    release(forest.tries, forest.reps, tested)
    return near, forest.members


def found(docs: DataFrame, **how: float) -> DataFrame:
    """All pairs of different rows (``id_a`` < ``id_b``) of at least the threshold's similarity, copies included."""
    near, members = links(docs, **how)
    copies = members.filter("id <> cls").select("cls").distinct().select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    return C.within(near.select("a", "b").unionByName(copies), members).filter("id_a < id_b").distinct()


def linked(docs: DataFrame, **how: float) -> DataFrame:
    """One row for each id with content: ``id``, ``class_id`` and ``n_links``, the other rows whose content is the same directly.

    Every pair of similar classes is verified for it; copies are counted by class.
    """
    near, members = links(docs, **how)
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"))
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sums = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("linked"))
    per_class = sizes.join(sums, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return members.join(per_class, "cls").select("id", F.col("cls").alias("class_id"), "n_links")


def groups(docs: DataFrame, threshold: float = 0.6, trees: int = 48, recall: float = 0.999, floor_recall: float = 0.99) -> DataFrame:
    """One row for each id with content: ``id``, ``class_id``, ``group_id``, ``class_size`` and ``group_size``.

    The class holds equal contents, the group whatever is linked through any chain, each named by its least id. A
    group needs no pair inside it that is linked already: each record is first held only against the least record of each of its subtrees, at the whole
    labels and at the floor, which costs m comparisons for m near-copies; then, at the floor, records of
    one subtree that are in different groups yet are compared in full, so that no link between groups is lost. What
    null, tiny and repeated texts and ids give is as in ``links``.
    """
    forest = Forest(docs, threshold, trees, recall, floor_recall)
    near = tested = None
    for depth in (forest.deepest, forest.floor):
        nodes = forest.nodes(depth)
        least = nodes.groupBy("root", "node").agg(F.min("cls").alias("a"))
        new = forest.likely(nodes.join(least, ["root", "node"]).filter("a < cls").select("a", F.col("cls").alias("b")), tested)
        found_ = forest.verified(new)
        near, tested = (found_, new) if near is None else (near.unionByName(found_), tested.unionByName(new))
    joined = C.components(near, "groups")
    nodes = forest.nodes(forest.floor).join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = nodes.groupBy("root", "node").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("root")
    nodes = stage(nodes.join(mixed, "root", "left_semi"), "mixed")  # at the floor a subtree is its root
    x, y = nodes.alias("x"), nodes.alias("y")
    apart = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component")))
    new = forest.likely(apart.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")), tested)
    over = forest.verified(new).select("a", "b")
    joined = C.components(joined.select(F.col("component").alias("a"), F.col("id").alias("b")).filter("a <> b").unionByName(over), "groups")
    release(forest.tries, forest.reps, nodes, new, tested)
    per_class = forest.members.groupBy("cls").agg(F.count("*").alias("class_size")).join(joined.withColumnRenamed("id", "cls"), "cls", "left").withColumn("group_id", F.coalesce("component", "cls"))
    sizes = per_class.groupBy("group_id").agg(F.sum("class_size").alias("group_size"))
    per_class = per_class.join(sizes, "group_id").select("cls", "group_id", "class_size", "group_size")
    return forest.members.join(per_class, "cls").select("id", F.col("cls").alias("class_id"), "group_id", "class_size", "group_size")
