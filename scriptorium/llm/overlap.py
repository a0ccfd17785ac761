"""Same or nearly same records across splits, by an edit-distance segment join.

The segments are the runs of five characters by which the content (letters and digits) is compared. All runs have one order: first those that one
side doesn't have, then the rarer before the more frequent. Of two texts with c runs in common, m of these are among the first r - c + m of either
text's r runs, wherever the edits are; a case has at least the threshold's part of the longer text's runs in common, and three quarters (at 0.6) of the
shorter one's. So each text gives only its first runs, a training text is a candidate where m of its substrings equal segments, and no case fails that.
Segments may stand at any position that the lengths allow, because
moved sentences don't make a record another one; the shift of each match is its diagonal. Along the
diagonals, a banded dynamic program aligns both contents. Candidates whose aligned parts cover enough are verified exactly.

How frequent runs are is read from two sketches of counts by hash, sized by the evaluation side and bounded (32 MB each); what they confuse changes the order, which is the
same for both sides all the same, and so only how many chance matches there are. A segment that very many texts share makes a large partition of one join key, which adaptive
execution splits; a pair's matches are aggregated where they are made before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import content as C
from scriptorium.session import release, stage

AGREE = 0.05  # part of its runs that a candidate must share among the first ones
BUCKETS_MOST = 1 << 25  # counts of one sketch at most, a byte each
PIECE = 1 << 16
BAND = 4
BLOCK = 2048  # characters of a text that are aligned in one go
DIAGONALS = 64  # pairs with matches on more diagonals aren't aligned along each, but go straight to the exact check


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs at all positions of all texts, one after the other, and where each text's begin (n + 1 offsets)."""
    data, at = C.codes(texts)
    h = C.windows(data, C.RUN)
    inside = np.ones(len(h), dtype=bool)
    for k in range(1, C.RUN):
        over = at[1:-1] - k
        inside[over[(over >= 0) & (over < len(h))]] = False
    return h[inside], np.concatenate([[0], np.cumsum(np.diff(at) - C.RUN + 1)])


def _tally(buckets: int, other):
    """content -> how often the partition has runs of each bucket (up to 255), in pieces; only buckets that the ``other`` sketch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = (_runs(batch.column(0).to_pylist())[0] & np.uint64(buckets - 1)).astype(np.int64)
            if other is not None:
                bucket = bucket[other.value[bucket] > 0]
            at, n = np.unique(bucket, return_counts=True)
            edges = np.flatnonzero(np.diff(at // PIECE)) + 1
            for part, many in zip(np.split(at, edges), np.split(n, edges)) if len(at) else ():
                held = pieces.setdefault(int(part[0] // PIECE), np.zeros(PIECE, dtype=np.uint8))
                held[part % PIECE] = np.minimum(255, held[part % PIECE] + many)
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([p.tobytes() for p in pieces.values()], pa.binary())], names=["piece", "counts"])

    return run


def _sketch(texts: DataFrame, buckets: int, other=None) -> np.ndarray:
    """By bucket 0 where ``texts`` (``content``) have no run, else 1 and the count's magnitude in eighths of a doubling; ``buckets`` bytes come to the driver at most."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, dtype=np.int64)
        for b in table.column("counts").to_pylist():
            total += np.frombuffer(b, dtype=np.uint8)
        level = np.where(total > 0, 1 + np.minimum(254, 8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    merged = texts.select("content").mapInArrow(_tally(buckets, other), "piece int, counts binary").groupBy("piece").applyInArrow(merge, "piece int, level binary")
    out = np.zeros(buckets, dtype=np.uint8)
    for row in merged.toLocalIterator():
        out[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.level, dtype=np.uint8)
    return out


def _first(r: int, part: float) -> int:
    """How many of a text's r runs come first if a case has at least that part of them in common, and m of these are to be among the first."""
    return r - math.ceil(part * r - 1e-9) + _agreeing(r)


def _agreeing(r: int) -> int:
    return max(1, int(r * AGREE))


def _segments(mine, others, threshold: float):
    """cls, content -> the segments: cls, r (distinct runs), segment (hash of a run), at (its first position), place (in the order of the text's runs, from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = mine.value, others.value
        mask = np.uint64(len(a) - 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            h, begins = _runs(batch.column(1).to_pylist())
            out: list[tuple[np.ndarray, ...]] = []
            for i, begin, end in zip(ids, begins[:-1].tolist(), begins[1:].tolist()):
                own = np.unique(h[begin:end])
                bucket = (own & mask).astype(np.int64)
                x, y = a[bucket], b[bucket]
                shared = np.flatnonzero((x > 0) & (y > 0))
                r, alone = len(own), len(own) - len(shared)
                most = _first(r, threshold) - alone
                if most <= 0:
                    continue
                order = np.lexsort((own[shared], x[shared].astype(np.int16) + y[shared]))[:most]
                kept = own[shared[order]]
                n = len(kept)
                every = h[begin:end]
                sort = np.argsort(every, kind="stable")
                at = sort[np.searchsorted(every[sort], kept)]
                out.append((np.full(n, i, np.int64), np.full(n, r, np.int32), kept.view(np.int64), at.astype(np.int32), np.arange(alone, alone + n, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["cls", "r", "segment", "at", "place"])

    return run


def _blocks(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], list[int]]:
    """Pairs cut into stretches of BLOCK characters, and which pair each is of."""
    out, of = [], []
    for k, (x, y, d) in enumerate(pairs):
        first = max(0, -d - BAND) // BLOCK * BLOCK  # before, the diagonal hasn't reached y
        for i in range(first, min(len(x), max(1, len(y) - d + BAND)), BLOCK):
            lo = max(0, i + d - BAND)
            out.append((x[i : i + BLOCK], y[lo : max(lo, i + d + BLOCK + BAND)], i + d - lo))
            of.append(k)
    return out, of


def aligned(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Local alignment score of each (a, b, diagonal) within BAND of its diagonal: +1 a match, -1 an edit.

    Texts are aligned in stretches of BLOCK characters whose best scores are added up: never less than the best of
    the whole, and memory depends on no text's length.
    """
    total = np.zeros(len(pairs), dtype=np.int32)
    pairs, of = _blocks(pairs)
    scores = np.zeros(len(pairs), dtype=np.int32)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
    offsets = np.arange(2 * BAND + 1, dtype=np.int32)
    for start in range(0, len(order), 256):
        jobs = order[start : start + 256]
        rows = max(len(pairs[k][0]) for k in jobs)
        a = np.zeros((rows, len(jobs)), dtype=np.uint32)
        b = np.zeros((rows + 2 * BAND, len(jobs)), dtype=np.uint32)  # b[i + o] is what a[i] meets at offset o
        for c, k in enumerate(jobs):
            x, y, diagonal = pairs[k]
            a[: len(x), c] = x + np.uint32(1)
            lo = max(0, diagonal - BAND)
            hi = min(len(y), diagonal + rows + BAND)
            if hi > lo:
                b[lo - diagonal + BAND : hi - diagonal + BAND, c] = y[lo:hi] + np.uint32(2)
        h = np.zeros((2 * BAND + 1, len(jobs)), dtype=np.int32)
        best = np.zeros(len(jobs), dtype=np.int32)
        for i in range(rows):
            step = np.where(a[i] + np.uint32(1) == b[i : i + 2 * BAND + 1], np.int32(1), np.int32(-1))
            step += h
            np.maximum(step[:-1], h[1:] - 1, out=step[:-1])
            np.maximum(step, 0, out=step)
            step += offsets[:, None]
            np.maximum.accumulate(step, axis=0, out=step)
            step -= offsets[:, None]
            h = step
            np.maximum(best, h.max(axis=0), out=best)
        scores[jobs] = best
    np.add.at(total, np.array(of, dtype=np.int64), scores)
    return total


def _covered(cover: float):
    """Candidates (a, b, diagonals, text_a, text_b) whose alignments cover at least that part of the shorter content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            jobs, owner = [], []
            sizes, total = np.empty(batch.num_rows), np.zeros(batch.num_rows)
            for k, (diagonals, s, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                x, y = (np.frombuffer(u.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for u in (s, t))
                sizes[k] = min(len(x), len(y))
                apart = []
                for d in sorted(diagonals):
                    if not apart or d - apart[-1] > BAND:  # matches within the band are one alignment
                        apart.append(d)
                if len(apart) > DIAGONALS:
                    total[k] = sizes[k]
                else:
                    jobs += [(x, y, d) for d in apart]
                    owner += [k] * len(apart)
            if jobs:
                np.add.at(total, np.array(owner, dtype=np.int64), aligned(jobs))
            keep = pa.array(total >= cover * sizes)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1, 3, 4)], names=["a", "b", "text_a", "text_b"])

    return run


def links(train: DataFrame, evaluation: DataFrame, threshold: float = 0.6, cover: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similar classes (``a`` of ``evaluation``, ``b`` of ``train``, ``similarity``) and the membership of both sides.

    Both inputs have ``id`` and ``text``. Texts whose content is shorter than a run (null, blank, tiny) and null ids have no part;
    a repeated id counts once; an empty side gives no links. Whole contents are cut, scanned and aligned, however long.
    """
    sides = []
    for name, rows in (("train", train), ("evaluation", evaluation)):
        texts = rows.select(F.col("id").cast("bigint").alias("id"), C.content("text").alias("content")).filter(f"id is not null and length(content) >= {C.RUN}")
        texts = stage(texts.withColumn("hash", F.unhex(F.md5("content"))), f"{name}-texts")
        members = stage(C.classes(texts), f"{name}-members")
        heads = members.filter("id = cls").select("id")
        sides.append((stage(texts.select("id", "content").join(heads, "id", "left_semi").dropDuplicates(["id"]), f"{name}-contents"), members))
        release(texts)
    (train_texts, train_members), (eval_texts, eval_members) = sides

    spark = train.sparkSession
    size = eval_texts.agg(F.sum(F.length("content"))).first()[0] or 1
    buckets = max(PIECE, min(BUCKETS_MOST, 1 << (2 * size - 1).bit_length()))
    eval_sketch = spark.sparkContext.broadcast(_sketch(eval_texts, buckets))
    train_sketch = spark.sparkContext.broadcast(_sketch(train_texts, buckets, eval_sketch))
    schema = "cls bigint, r int, segment bigint, at int, place int"
    left = eval_texts.select("id", "content").mapInArrow(_segments(eval_sketch, train_sketch, threshold), schema).toDF("a", "r_a", "segment", "at_a", "place_a")
    right = train_texts.select("id", "content").mapInArrow(_segments(eval_sketch, train_sketch, threshold), schema).toDF("b", "r_b", "segment", "at_b", "place_b")
    # With moved parts every position is allowed, as long as the fewer runs can be enough of the more.
    met = left.join(right, "segment").filter((F.col("r_a") >= F.col("r_b") * threshold) & (F.col("r_b") >= F.col("r_a") * threshold))
    # Both sizes tell how much a case has in common, and so among which of either's first runs the agreeing ones are.
    least = F.greatest(F.lit(1), F.floor(F.least("r_a", "r_b") * F.lit(AGREE)).cast("int"))
    common = F.ceil((F.col("r_a") + F.col("r_b")) * (threshold / (1 + threshold)) - 1e-9)
    met = met.filter((F.col("place_a") < F.col("r_a") - common + least) & (F.col("place_b") < F.col("r_b") - common + least))
    met = met.groupBy("a", "b", least.alias("least")).agg(F.collect_set(F.col("at_b") - F.col("at_a")).alias("diagonals"), F.count("*").alias("agreeing"))
    met = met.filter("agreeing >= least").drop("least", "agreeing")
    met = stage(met, "met")
    gone = [met]
    for side in ("a", "b"):
        texts = eval_texts if side == "a" else train_texts
        ids = met.select(F.col(side).alias("id")).distinct()
        texts = C.only(texts, ids).select(F.col("id").alias(side), F.col("content").alias(f"text_{side}"))
        met = met.join(texts, side)
    pairs = met.select("a", "b", "diagonals", "text_a", "text_b").mapInArrow(_covered(cover), "a bigint, b bigint, text_a string, text_b string")
    near = stage(C.verify(pairs, threshold), "overlaps")
    release(*gone, train_texts, eval_texts)
    return near, train_members, eval_members


def found(train: DataFrame, evaluation: DataFrame, **how: float) -> DataFrame:
    """All pairs of a training and an evaluation row of the same content: ``train_id``, ``eval_id``, ``similarity``."""
    near, train_members, eval_members = links(train, evaluation, **how)
    same = near.join(eval_members.select(F.col("cls").alias("a"), F.col("id").alias("eval_id")), "a")
    return same.join(train_members.select(F.col("cls").alias("b"), F.col("id").alias("train_id")), "b").select("train_id", "eval_id", "similarity")


def report(train: DataFrame, evaluation: DataFrame, **how: float) -> DataFrame:
    """Per ``split`` and ``source`` of ``evaluation`` (``id``, ``text``, ``split``, ``source``): its rows, and how many overlap with ``train``.

    ``n_rows``, ``n_overlapping`` (has a partner), ``n_exact`` (has one of equal content), ``n_pairs`` and ``overlap_share``.
    A null source is a source of its own.
    """
    near, train_members, eval_members = links(train, evaluation, **how)
    sizes = train_members.groupBy(F.col("cls").alias("b")).agg(F.count("*").alias("partners"))
    per_class = near.join(sizes, "b").groupBy(F.col("a").alias("cls")).agg(F.sum("partners").alias("partners"), F.max((F.col("similarity") == 1).cast("int")).alias("exact"))
    per_row = eval_members.join(per_class, "cls").select("id", "partners", "exact")
    rows = evaluation.select(F.col("id").cast("bigint").alias("id"), "split", "source").join(per_row, "id", "left")
    out = rows.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("partners").alias("n_overlapping"), F.coalesce(F.sum(F.col("exact").cast("bigint")), F.lit(0)).alias("n_exact"), F.coalesce(F.sum("partners"), F.lit(0)).alias("n_pairs"))
    return out.withColumn("overlap_share", F.round(F.col("n_overlapping") / F.col("n_rows"), 6))
