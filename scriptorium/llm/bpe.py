"""Byte-level BPE encoding of a whole table with a public vocabulary.

Texts are cut into words by the vocabulary's published pattern. Inside a word, two neighbouring bytes
that occur side by side in no vocabulary entry can never end up in one token, so the word falls
apart there into segments that are encoded independently; this is exact. Each distinct segment
of a batch is encoded once: a segment tree over its byte positions holds the leftmost minimum
rank of the neighbouring pairs; every merge takes the root and makes point updates at the merged
position, the position that vanishes and the live neighbour before it, so a segment of n bytes
costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = 1 << 62  # beyond any pair of any text
_CACHE_LIMIT = 400_000


class Encoder:
    """Encodes batches of texts; one per Python worker and vocabulary."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.words = regex.compile(PATTERN).findall
        joined = np.zeros(65536, dtype=bool)
        for token in self.ranks:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.uint32)
            joined[b[:-1] * 256 + b[1:]] = True
        self.joined = joined
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.known: dict[bytes, tuple[int, ...]] = {}

    def merge(self, segment: bytes) -> tuple[int, ...]:
        """Token ids of one segment, by lowest rank first and leftmost among equals."""
        found = self.ranks.get(segment)
        if found is not None and len(segment) <= 2:
            return (found,)
        n, ranks = len(segment), self.ranks
        if n == 1:
            return (self.single[segment[0]],)
        piece: list[bytes | None] = [segment[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1
        while size < n - 1:
            size *= 2
        tree = [NONE] * (2 * size)
        # A node's value is rank * n + position: the minimum is the leftmost pair of least rank.
        for i in range(n - 1):
            rank = ranks.get(segment[i : i + 2])
            if rank is not None:
                tree[size + i] = rank * n + i
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            node //= 2
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                low = left if left <= right else right
                if tree[node] == low:
                    break
                tree[node] = low
                node //= 2

        while tree[1] < NONE:
            i = tree[1] % n
            j = after[i]
            piece[i] += piece[j]  # type: ignore[operator]
            piece[j] = None
            k = after[j]
            after[i] = k
            if j < n - 1:
                put(j, NONE)
            if k < n:
                before[k] = i
                rank = ranks.get(piece[i] + piece[k])  # type: ignore[operator]
                put(i, NONE if rank is None else rank * n + i)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                rank = ranks.get(piece[h] + piece[i])  # type: ignore[operator]
                put(h, NONE if rank is None else rank * n + h)
        return tuple(ranks[p] for p in piece if p is not None)

    def _ids_of(self, segment: bytes) -> tuple[int, ...]:
        ids = self.known.get(segment)
        if ids is None:
            if len(self.known) > _CACHE_LIMIT:
                self.known.clear()
            ids = self.known[segment] = self.merge(segment)
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the n + 1 offsets at which each begins."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))) if raw else np.zeros(0, np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(raw) + 1, np.int64)
        words: list[int] = []
        for t in texts:
            if t:
                words.extend(map(len, self.words(t)))
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each character begins
        chars = np.cumsum(np.asarray(words, dtype=np.int64))[:-1]
        cut = np.empty(len(data), dtype=bool)
        cut[0] = True
        wide = data.astype(np.uint16)
        np.logical_not(self.joined[(wide[:-1] << 8) | wide[1:]], out=cut[1:])
        cut[starts[chars]] = True
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(data)))

        # Segments of up to seven bytes are one integer each, the length in its top byte.
        short = length <= 7
        code = np.zeros(len(begin), dtype=np.uint64)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for k in range(7):
            has = length > k
            byte = padded[begin + k].astype(np.uint64)
            code = np.where(has, code | (byte << np.uint64(8 * k)), code)
        code |= np.minimum(length, 8).astype(np.uint64) << np.uint64(56)
        if not short.all():
            long_at = np.flatnonzero(~short)
            blob = data.tobytes()
            seen: dict[bytes, int] = {}
            for at in long_at:
                b = blob[begin[at] : begin[at] + length[at]]
                code[at] = (255 << 56) | seen.setdefault(b, len(seen))
            names = list(seen)
        distinct, which = np.unique(code, return_inverse=True)
        lists = []
        for c in distinct.tolist():
            n = c >> 56
            lists.append(self._ids_of(names[c & 0xFFFFFFFFFFFF] if n == 255 else (c & ((1 << 56) - 1)).to_bytes(7, "little")[:n]))
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), dtype=np.int32, count=int(sizes.sum()))
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        each = sizes[which]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(at[which] - total[:-1], each) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total[np.searchsorted(begin, ends, side="left")]])


def _slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about ``most`` bytes, so that a batch of very long texts needs no more memory."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (the token ids of ``text``, without special tokens) of every row.

    Null and empty texts give an empty list; a null key stays a row of its own; repeated rows give
    repeated rows; other columns are dropped, whatever their names. Texts of any length are encoded whole.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind.simpleString()}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``n_tokens`` (BIGINT, 0 for null and empty texts) of every row; the ids never leave Python."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                part = batch.slice(a, b - a)
                _, offsets = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets))], names=["key", "n_tokens"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind.simpleString()}, n_tokens bigint")
    return out.withColumnRenamed("key", key)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``text`` of every row's token ids; null ids and unknown ones are an error of the row: its text is null."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r: t for t, r in Encoder.of(vocabulary).ranks.items()}
        for batch in batches:
            out: list[str | None] = []
            for own in batch.column(1).to_pylist():
                found = [tokens.get(i) for i in own] if own is not None else [None]
                out.append(None if None in found else b"".join(found).decode("utf-8", "replace"))  # type: ignore[arg-type]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind.simpleString()}, text string").withColumnRenamed("key", key)
