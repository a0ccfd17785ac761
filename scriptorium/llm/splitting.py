"""Splitting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest; a cut goes behind the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*|(?<=\n)(?=#{1,6} )")),
    ("line", re.compile("\r\n|[\n\r\x85\u2028\u2029]")),
    ("sentence", re.compile(r"[。！？!?…]+[”’」』）)\]\"']*\s*|\.[”’\"')\]]*\s+")),
    ("clause", re.compile(r"[，；：、,;:—]+[”’\"']*\s*")),
    ("word", re.compile(r"\s+|(?<=[㐀-鿿豈-﫿])(?=[^\W㐀-鿿豈-﫿])|(?<=[^\W㐀-鿿豈-﫿])(?=[㐀-鿿豈-﫿])")),
)


def _inside_character(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part what is read as one character."""
    here, last = text[at], text[at - 1]
    if "\u200d" in (last, here) or "\ufe00" <= here <= "\ufe0f" or "\U0001f3fb" <= here <= "\U0001f3ff" or (last == "\r" and here == "\n"):
        return True
    return unicodedata.combining(here) != 0 or unicodedata.category(here) in ("Mn", "Me")


def _nearest(at: list[int], middle: int, low: int, high: int) -> int | None:
    """Of the ascending places those from ``low`` to ``high`` nearest the middle."""
    k = bisect.bisect_left(at, middle)
    near = [p for p in at[max(0, k - 1) : k + 1] if low <= p <= high]
    return min(near, key=lambda p: abs(p - middle)) if near else None


def cuts(text: str, most: int) -> list[tuple[int, str]]:
    """Starts of the cores that ``text`` falls into, each at most ``most`` long, and what boundary lies before each.

    A stretch is cut at its strongest boundary within the middle half, nearest the middle. Where the middle half has no boundary at all,
    the strongest is taken wherever one cut leaves two cores that fit, or, of a stretch of more than two cores, anywhere in it.
    Only a stretch without any such boundary is cut between characters.
    """
    marks = [(name, sorted({m.end() for m in pattern.finditer(text)})) for name, pattern in BOUNDARIES]
    found: list[tuple[int, str]] = [(0, "start")]
    waiting = [(0, len(text))]
    while waiting:
        a, b = waiting.pop()
        if b - a <= most:
            continue
        middle, reach = (a + b) // 2, (b - a) // 4
        whole = (b - most, a + most) if b - a <= 2 * most else (a + 1, b - 1)
        for low, high in ((middle - reach, middle + reach), whole):
            cut, name = next(((p, name) for name, at in marks if (p := _nearest(at, middle, max(low, a + 1), min(high, b - 1))) is not None), (None, ""))
            if cut is not None:
                break
        else:
            # No boundary: between characters, nearest the middle; amid an endless cluster, at the middle itself.
            cut, name = next((p for d in range(reach) for p in (middle - d, middle + d) if a < p < b and not _inside_character(text, p)), middle), "character"
        found.append((cut, name))
        waiting += [(a, cut), (cut, b)]
    return sorted(found)


def _overlapping(text: str, start: int, before: int, overlap: int) -> int:
    """Where the piece of a core from ``start`` begins: ``overlap`` before it, or up to the next character's begin where that is inside one."""
    first = max(before, start - overlap)
    return next((p for p in range(first, start + 1) if p == start or p == 0 or not _inside_character(text, p)), first) if overlap else start


def split(docs: DataFrame, limit: int = 2000, overlap: int = 200, key: str = "row_id", text: str = "text") -> DataFrame:
    """Pieces of every text of more than ``limit`` characters.

    Columns ``key``, ``piece`` (0, 1, ...), ``n_pieces``, ``start`` and ``end`` (characters of the whole text, from 0, end excluded),
    ``core`` (where the piece's own part begins), ``boundary`` (what the core begins behind) and ``piece_text``. A text is cut at the strongest boundary in the middle
    half, nearest the middle, or, where there is none, wherever a boundary leaves pieces that fit, and the parts again until each is at most ``limit - overlap``; then every piece but the first is
    extended to the left by ``overlap`` characters, or by the few less that keep it from beginning inside what is read as one character. The pieces cover the text and each has at most ``limit`` characters.
    Texts up to the limit, null and empty ones give no rows; repeated rows give repeated pieces; other columns are dropped.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                starts = cuts(t, limit - overlap)
                for k, (core, boundary) in enumerate(starts):
                    end = starts[k + 1][0] if k + 1 < len(starts) else len(t)
                    begin = _overlapping(t, core, 0, overlap)
                    of.append(i)
                    rows.append((k, len(starts), begin, core, end, boundary, t[begin:end]))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int32()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["key", "piece", "n_pieces", "start", "core", "end", "boundary", "piece_text"])

    oversized = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit)
    return oversized.mapInArrow(run, f"key {kind}, piece int, n_pieces int, start int, core int, end int, boundary string, piece_text string").withColumnRenamed("key", key)


def round_trip(pieces: DataFrame, limit: int = 2000, overlap: int = 200, key: str = "row_id") -> DataFrame:
    """What the pieces of each ``key`` (unique) put together again give: ``text_hash`` (md5), and whether they are kept to.

    ``in_order``: numbered 0, 1, ... and each core begins where the last one ends; ``fits``: no piece is over the limit; ``overlaps``:
    each piece but the first repeats ``overlap`` characters, or fewer only where it would begin inside a character;
    ``parted``: pieces whose core begins inside what is read as one character.
    """
    inside = F.col("piece_text").rlike(r"^[\p{Mn}\p{Me}\x{200d}\x{fe00}-\x{fe0f}\x{1f3fb}-\x{1f3ff}]")
    each = pieces.select(
        key, "piece", "n_pieces", "core", "end", (F.length("piece_text") <= limit).alias("fits"), ((F.col("core") == 0) | ((F.col("core") - F.col("start") <= overlap) & ~inside)).alias("overlaps"),
        F.expr("substring(piece_text, core - start + 1)").alias("own"),
    )
    own = each.withColumn("parted", F.when(F.col("piece") > 0, F.col("own").rlike(r"^[\p{Mn}\p{Me}\x{200d}\x{fe00}-\x{fe0f}\x{1f3fb}-\x{1f3ff}]").cast("int")).otherwise(0))
    together = own.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("piece", "core", "end", "own", "n_pieces"))).alias("p"), F.bool_and("fits").alias("fits"), F.bool_and("overlaps").alias("overlaps"), F.sum("parted").alias("parted"))
    right = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (F.get("p", i)["piece"] == i) & (F.get("p", i)["n_pieces"] == F.size("p")) & ((i == 0) & (F.get("p", i)["core"] == 0) | (i > 0) & (F.get("p", i)["core"] == F.get("p", i - 1)["end"])))
    return together.select(key, F.md5(F.concat_ws("", "p.own")).alias("text_hash"), F.coalesce(right, F.lit(False)).alias("in_order"), "fits", "overlaps", F.col("parted").cast("bigint").alias("parted"))
