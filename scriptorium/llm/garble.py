"""Text decoded with the wrong character encoding: finding and restoring it with a hidden Markov model.

The model has one clean state and one state per encoding pair (what the bytes were, as what they were read). The
clean state emits characters as the corpus has them after an ASCII letter, a Chinese character, an accented or Cyrillic letter or anything else; a pair's state emits what its damage makes
of characters drawn from the corpus, where the encoding can put them. States other than the clean
one follow only themselves or the clean one; how often they are entered and how soon they are left is counted in the last labelling. Each text gets its most probable labelling (Viterbi);
each labelled span gets its state's inverse transform. A span's likelihood is then taken as a whole: as the clean state's likelihood of what the inverse
gives, against that of what stands there. This is the emission that single characters bound from above, and a span that it doesn't favour is clean.

Two shortcuts leave the result as it is: a state whose best stretch of evidence, even if every
character were well placed, can't pay for entering it is left out of a text, and a text with no state left is clean.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOST = "�"
#: (name, what the bytes were, as what they were read, times, scripts that it happens to)
PAIRS = tuple(
    (f"{a}>{b}" + (f" x{n}" if n > 1 else ""), a, b, n, scripts)
    for a, b, n, scripts in (
        ("utf-8", "cp1252", 1, "hlc"), ("utf-8", "latin-1", 1, "hlc"), ("utf-8", "mac_roman", 1, "hlc"), ("utf-8", "cp1251", 1, "hlc"),
        ("utf-8", "cp437", 1, "hlc"), ("utf-8", "koi8_r", 1, "hc"), ("utf-8", "gb18030", 1, "hlc"), ("utf-8", "big5", 1, "hc"), ("utf-8", "cp932", 1, "hc"), ("utf-8", "cp949", 1, "hc"),
        ("utf-8", "cp1252", 2, "hlc"), ("utf-8", "latin-1", 2, "hlc"),
        ("gb18030", "cp1252", 1, "h"), ("gb18030", "latin-1", 1, "h"), ("gb18030", "utf-8", 1, "h"), ("gb18030", "big5", 1, "h"), ("gb18030", "cp932", 1, "h"), ("gb18030", "cp949", 1, "h"), ("gb18030", "cp1251", 1, "h"),
        ("big5", "gb18030", 1, "h"), ("big5", "cp1252", 1, "h"), ("big5", "latin-1", 1, "h"), ("big5", "utf-8", 1, "h"),
        ("cp1252", "utf-8", 1, "l"), ("cp1251", "utf-8", 1, "c"), ("cp1251", "cp1252", 1, "c"), ("cp1251", "latin-1", 1, "c"), ("koi8_r", "cp1251", 1, "c"), ("cp1251", "koi8_r", 1, "c"), ("koi8_r", "cp1252", 1, "c"),
    )
)
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "koi8_r")
#: Pairs under which a lone character beyond ASCII says nothing: UTF-8 read by single bytes makes at least two of each, two-byte
#: encodings are read in pairs, and letters for letters come in words.
SEVERAL = [k for k, (_, was, as_, _, _) in enumerate(PAIRS) if as_ != "utf-8" and (was != "utf-8" or as_ in SINGLE)]
LEAST = 2e-7  # probability of a character that a state never showed
RARE = 2e-6  # no character counts as rarer than this in clean text
DRAWN = 240_000  # characters drawn for a pair's emissions
BACKOFF = 1_000.0  # characters of any context that a context's own counts are mixed with

_TABLES: dict[str, tuple[str, dict[str, int]]] = {}


def _single(codec: str) -> tuple[str, dict[str, int]] | None:
    """The 256 characters of a one-byte encoding, undefined bytes as control characters, and their bytes."""
    if codec not in SINGLE:
        return None
    if codec not in _TABLES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(codec))
            except UnicodeDecodeError:
                chars.append(chr(b))
        _TABLES[codec] = "".join(chars), {c: b for b, c in enumerate(chars)}
    return _TABLES[codec]


def read(data: bytes, codec: str) -> str:
    """Bytes as a careless reader decodes them."""
    table = _single(codec)
    return "".join([table[0][b] for b in data]) if table else data.decode(codec, "replace")


def unread(text: str, codec: str) -> bytes | None:
    """The bytes that ``read`` had, or None."""
    table = _single(codec)
    if table:
        found = [table[1].get(c) for c in text]
        return None if None in found else bytes(found)  # type: ignore[arg-type]
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def damage(text: str, was: str, as_: str, times: int) -> str:
    for _ in range(times):
        text = read(text.encode(was, "ignore"), as_)
    return text


def _script(c: str) -> str:
    o = ord(c)
    if 0x3400 <= o <= 0x9FFF or 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFF60:
        return "h"
    if 0x400 <= o <= 0x45F:
        return "c"
    if (0xC0 <= o <= 0x17F and o not in (0xD7, 0xF7)) or o in (0x2018, 0x2019, 0x201C, 0x201D, 0x201E, 0x2013, 0x2014, 0x2026, 0x20AC, 0xA3, 0xAB, 0xBB, 0xB0):
        return "l"
    return ""


#: What stands before a character decides how likely it is in clean text: an ASCII letter, a Chinese character,
#: an accented letter or mark, a Cyrillic letter, or anything else.
CONTEXTS = 5
_CONTEXT = np.zeros(0x110000, dtype=np.int8)
for _c in range(0x10000):
    _CONTEXT[_c] = {"h": 2, "l": 3, "c": 4}.get(_script(chr(_c)), int(_c < 0x80 and chr(_c).isalpha()))
SHIFT = 0x110000
#: Counts beyond those of the characters: garbled stretches of each pair, characters of stretches up to STAY, and stretches that end before.
STRETCHES = SHIFT * CONTEXTS
STAY = 24  # stays are told apart up to this length; how long the longer ones are says nothing about how short ones end
STRETCH = 1 << 17  # characters of a text that are held against all states at a time
MISPLACED = -9.0  # a character that the pair's encoding can't have put there: noise of one in 10,000


def before(data: np.ndarray, first: int = 0) -> np.ndarray:
    """The context of each character of a text; ``first`` is that of the first."""
    out = np.empty(len(data), dtype=np.int8)
    out[:1] = first
    out[1:] = _CONTEXT[data[:-1]]
    return out


class Model:
    """Log likelihoods of the clean state by context and character, and of each pair's state by character."""

    def __init__(self, counts: dict[int, int], labelled: bool = True) -> None:
        """``counts``: how often the corpus has each code point in each context (context times 0x110000 and the code point), and its garbled stretches."""
        seen = {c: n for c, n in counts.items() if c < STRETCHES}
        single: dict[int, int] = {}
        for c, n in seen.items():
            single[c % SHIFT] = single.get(c % SHIFT, 0) + n
        total = max(1, sum(single.values()))
        chars = sorted(single)
        self.index = np.zeros(SHIFT, dtype=np.int32)
        self.index[np.array(chars, dtype=np.int64)] = np.arange(1, len(chars) + 1)
        never = np.array([c == 0xFFFD or 0x80 <= c <= 0x9F and c != 0x85 or 0xE000 <= c <= 0xF8FF for c in chars], dtype=bool)
        clean = np.where(never, LEAST, np.maximum(np.array([single[c] for c in chars], dtype=float) / total, RARE))
        given = np.zeros((CONTEXTS, len(chars)))
        keys = np.array(sorted(seen), dtype=np.int64)
        given[keys // SHIFT, self.index[keys % SHIFT] - 1] = [seen[k] for k in keys.tolist()]
        given[:, never] = 0
        given = (given + BACKOFF * clean) / (given.sum(axis=1, keepdims=True) + BACKOFF)
        self.clean = np.full((CONTEXTS, len(chars) + 1), np.log(LEAST), dtype=np.float32)
        self.clean[:, 1:] = np.log(np.maximum(given, LEAST))
        self.made = np.zeros((len(PAIRS), len(chars) + 1), dtype=np.float32)
        rng = np.random.default_rng(11)
        by_script: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for s in "hlc":
            own = np.array([c for c in chars if _script(chr(c)) == s and single[c] >= total * RARE / 4], dtype=np.int64)
            if len(own):
                p = np.array([single[c] for c in own.tolist()], dtype=float) ** 0.75
                by_script[s] = own, p / p.sum()
        ascii_ = np.array([c < 0x80 for c in chars], dtype=bool)
        letter = np.array([c < 0x80 and chr(c).isalpha() for c in chars], dtype=bool)
        self.plain = np.zeros((len(PAIRS), len(chars) + 1), dtype=np.float32)  # ASCII characters against the clean state
        for k, (_, was, as_, times, scripts) in enumerate(PAIRS):
            emitted = np.zeros(len(chars))
            used = [s for s in scripts if s in by_script]
            for s in used:
                own, p = by_script[s]
                drawn = "".join(map(chr, rng.choice(own, DRAWN // 2 if s == "h" else DRAWN // 8, p=p)))
                if s == "l":  # single letters amid others
                    drawn = " ".join(drawn)
                out = np.frombuffer(damage(drawn, was, as_, times).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                out = out[out >= 0x80]
                got = np.bincount(self.index[out], minlength=len(chars) + 1)[1:].astype(float)
                emitted += got / max(1, len(out)) / len(used)
            # What a pair never makes speaks against it, however rare it is.
            self.made[k, 1:] = np.where(emitted < LEAST, np.minimum(np.log(clean) - 2.0, np.log(LEAST)), np.log(np.maximum(emitted, LEAST)))
            self.plain[k, 1:] = np.where(ascii_, np.where(letter & ("l" not in scripts), -1.0, -0.02), 0)
        self.made[:, 0] = np.log(LEAST) - 2.0
        # Contexts that aren't labelled yet are full of garbled characters after garbled ones, so paths do without them.
        self.path = self.clean if labelled else np.repeat(np.concatenate([[np.log(LEAST)], np.log(clean)])[None, :], CONTEXTS, axis=0).astype(np.float32)
        self.top = (self.made.max(axis=0)[None, :] - self.path).astype(np.float32)
        self.top[:, 1:][:, ascii_] = -0.02
        self.chars = [""] + [chr(c) for c in chars]
        self._raw: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # Transitions: how often the last labelling entered each pair's state, and how soon it left. Half is the prior.
        entered = [counts.get(STRETCHES + k, 0) for k in range(len(PAIRS))]
        inside, left = counts.get(STRETCHES + len(PAIRS), 0), counts.get(STRETCHES + len(PAIRS) + 1, 0)
        self.enter = np.array([math.log((e / (total + inside) + 1e-3 / len(PAIRS)) / 2) for e in entered])
        self.leave = math.log((left + 50) / (inside + 1_000))
        self.lost = math.log(0.1)

    def likelihood(self, text: str, first: int, lost: float) -> tuple[float, int]:
        """Log likelihood of clean text after a context, each lost character counting ``lost``, and the context that it leaves."""
        data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(data):
            return 0.0, first
        gone = data == 0xFFFD
        each = self.clean[before(data, first), self.index[data]]
        return float(each[~gone].sum() + lost * gone.sum()), int(_CONTEXT[data[-1]])

    def raw(self, codec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the characters were read from, FF where that can't be: all bytes, and by index where a character's begin and how many they are."""
        if codec not in self._raw:
            made = [c.encode() if c.isascii() and c else (unread(c, codec) if c and c != LOST else None) or b"\xff" for c in self.chars]
            sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
            self._raw[codec] = np.frombuffer(b"".join(made), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes
        return self._raw[codec]


def _lone(high: np.ndarray) -> np.ndarray:
    """Characters beyond ASCII that stand alone."""
    near = np.zeros(len(high), dtype=bool)
    near[1:] |= high[:-1]
    near[:-1] |= high[1:]
    return high & ~near


def _placed(model: Model, data: np.ndarray, at: np.ndarray, as_: str) -> np.ndarray:
    """Which characters (code points and their indexes) stand where UTF-8 read as ``as_`` could have put them; ASCII ones do."""
    high = data >= 0x80
    raw, begins, sizes = model.raw(as_)
    size = sizes[at]
    first = np.cumsum(size) - size
    made = raw[np.arange(int(size.sum())) + np.repeat(begins[at] - first, size)] if sizes.max(initial=1) > 1 else raw[begins[at]]
    wide = np.concatenate([made, np.zeros(4, dtype=np.uint8)])
    follows = (wide & 0xC0) == 0x80
    n = len(made)
    # Sequences of UTF-8 can't overlap, since what begins one never continues one.
    two = (made >= 0xC2) & (made <= 0xDF) & follows[1 : n + 1]
    three = (made >= 0xE0) & (made <= 0xEF) & follows[1 : n + 1] & follows[2 : n + 2]
    four = (made >= 0xF0) & (made <= 0xF4) & follows[1 : n + 1] & follows[2 : n + 2] & follows[3 : n + 3]
    whole = two | three | four
    longer = three | four
    inside = np.zeros(n + 3, dtype=bool)
    for k, begin in enumerate((whole, whole, longer, four)):
        inside[k : n + k] |= begin
    ok = np.logical_or.reduceat(inside[:n], first)
    # What couldn't be read belongs to the character before it.
    lost = data == 0xFFFD
    if lost.any():
        held = np.where(lost, -1, np.arange(len(data)))
        held = np.maximum.accumulate(held)
        ok = np.where(lost, (held >= 0) & ok[held] & high[held], ok)
    return ok | ~high


def _through(x: np.ndarray) -> np.ndarray:
    """For each row and position the largest sum of a stretch that holds it."""

    def ending(y: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y, axis=1, dtype=np.float64)], axis=1)
        return total[:, 1:] - np.minimum.accumulate(total[:, :-1], axis=1)

    return ending(x) + ending(x[:, ::-1])[:, ::-1] - x


def _best_stretches(x: np.ndarray) -> np.ndarray:
    """For each row the largest sum of a stretch."""
    total = np.zeros((len(x), x.shape[1] + 1), dtype=np.float32)
    np.cumsum(x, axis=1, out=total[:, 1:])
    return (total - np.minimum.accumulate(total, axis=1)).max(axis=1)


def _viterbi(jobs: list[np.ndarray], enter_: list[np.ndarray], leave_: float) -> list[list[tuple[int, int, int]]]:
    """For each job (states by positions) the spans (begin, end, state) that its most probable path spends outside the clean state.

    Jobs of like length advance together, a position at a time.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in jobs]
    order = sorted(range(len(jobs)), key=lambda k: jobs[k].shape[1])
    while order:
        longest = jobs[order[-1]].shape[1]
        take = [order.pop()]
        most = jobs[take[0]].shape[0]
        while order and len(take) < 256 and jobs[order[-1]].shape[1] * 8 > longest and longest * max(most, jobs[order[-1]].shape[0]) * (len(take) + 1) < 4_000_000:
            take.append(order.pop())
            most = max(most, jobs[take[-1]].shape[0])
        rows = np.full((longest, len(take), most), -50.0, dtype=np.float32)
        sizes = np.array([jobs[k].shape[1] for k in take])
        entering = np.full((len(take), most), -1e9)
        for r, k in enumerate(take):
            entering[r, : len(enter_[k])] = enter_[k]
        for r, k in enumerate(take):
            rows[: sizes[r], r, : jobs[k].shape[0]] = jobs[k].T
        clean, there = np.zeros(len(take)), np.full((len(take), most), -1e9)
        entered = np.empty((longest, len(take), most), dtype=bool)
        left = np.empty((longest, len(take)), dtype=bool)  # whether the clean state was reached from the likeliest other one
        history = np.empty((longest, len(take), most), dtype=np.float32)
        state = np.full(len(take), -1)
        alive = len(take)
        for t in range(longest):
            # The longest come first; those that have ended are left out.
            x, c = there[:alive], clean[:alive]
            history[t, :alive] = x
            leave = x.max(axis=1) + leave_
            enter = c[:, None] + entering[:alive]
            np.greater(enter, x, out=entered[t, :alive])
            np.maximum(enter, x, out=x)
            x += rows[t, :alive]
            np.greater(leave, c, out=left[t, :alive])
            np.maximum(c, leave, out=c)
            while alive and sizes[alive - 1] == t + 1:  # a text may end garbled
                alive -= 1
                top = int(there[alive].argmax())
                if there[alive, top] > clean[alive]:
                    state[alive] = top
        for r, k in enumerate(take):
            now, end = int(state[r]), int(sizes[r])
            for t in range(int(sizes[r]) - 1, -1, -1):
                if now >= 0:
                    if entered[t, r, now]:
                        out[k].append((t, end, now))
                        now = -1
                elif left[t, r]:
                    now, end = int(history[t, r].argmax()), t
            out[k].reverse()
    return out


def _inverse(span: str, was: str, as_: str, times: int) -> tuple[str, bool]:
    """The span with its damage undone as far as that goes, and whether nothing was lost."""
    whole = True
    for _ in range(times):
        out = []
        for part in re.split("(�+)", span):
            if not part:
                continue
            if part[0] == LOST:
                out.append(LOST)
                whole = False
                continue
            data = unread(part, as_)
            if data is None:
                pieces = [unread(c, as_) for c in part]
                whole &= None not in pieces
                data = b"".join(p if p is not None else b"\xff" for p in pieces)
            text = data.decode(was, "replace")
            whole &= LOST not in text
            out.append(text)
        span = re.sub("�+", LOST, "".join(out))
    return span, whole


def _evidence(model: Model, span: str, restored: str, last: str, following: str, state: int) -> float:
    """Log likelihood ratio of a whole stretch: what it was, as clean text, through the pair's transform, against what stands there as clean text.

    The states' emissions by single characters know what a pair can make; this knows what it made it of. A character lost in the
    stretch is one that clean text doesn't have; one that the inverse itself can't read speaks as much against the pair.
    """
    first = int(_CONTEXT[ord(last)]) if last else 0
    own_lost = min(span.count(LOST), restored.count(LOST))
    was, end = model.likelihood(restored, first, 0.0)
    stands, here = model.likelihood(span, first, math.log(LEAST))
    was += own_lost * model.lost + (restored.count(LOST) - own_lost) * 2 * math.log(LEAST)
    if following:
        at = int(model.index[ord(following)])
        was, stands = was + float(model.clean[end, at]), stands + float(model.clean[here, at])
    return was - stands + float(model.enter[state]) + model.leave


def _runs(on: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Begin and end of each run of true values, cut where it is longer than ``most``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(x, min(x + most, int(b))) for a, b in edges.reshape(-1, 2) for x in range(int(a), int(b), most)]


def _regions(model: Model, text: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Where a text may not be clean: begin, the states that may be there, and their ratios."""
    if text.isascii():
        return []
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at, context = model.index[data], before(data)
    need = -model.enter.max()
    top = model.top[context, at]
    if np.maximum(top, 0).sum() <= need or _best_stretches(top[None, :])[0] <= need:
        return []
    found = []
    for start, stop in _runs(_through(top[None, :])[0] > need, STRETCH):
        found += _region(model, data, at, context, start, stop, need)
    return found


def _region(model: Model, data: np.ndarray, at: np.ndarray, context: np.ndarray, start: int, stop: int, need: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    left, right = max(0, start - 8), min(len(data), stop + 8)  # what is placed is told with the neighbours
    wide, wide_at = data[left:right], at[left:right]
    data, at, context = data[start:stop], at[start:stop], context[start:stop]
    plain = np.flatnonzero(data < 0x80)
    ratios = model.made[:, at] - model.path[context, at]
    ratios[:, plain] = model.plain[:, at[plain]]
    ratios[np.ix_(SEVERAL, np.flatnonzero(_lone(wide >= 0x80)[start - left : stop - left]))] = MISPLACED
    likely = np.flatnonzero(np.maximum(ratios, 0).sum(axis=1) > need)
    rows = ratios[likely]
    worthy = _best_stretches(rows) > need
    likely, rows = likely[worthy], rows[worthy]
    if not len(likely):
        return []
    places: dict[str, np.ndarray] = {}
    for row, k in zip(rows, likely.tolist()):
        _, was, as_, _, _ = PAIRS[k]
        if was == "utf-8":
            if as_ not in places:
                places[as_] = ~_placed(model, wide, wide_at, as_)[start - left : stop - left]
            row[places[as_]] = MISPLACED
    # A span of a state in the best path pays for entering, so it lies where a stretch that does is possible.
    active = _through(rows) > need
    found = []
    for x, y in _runs(active.any(axis=0), STRETCH):
        use = np.flatnonzero(active[:, x:y].any(axis=1))
        found.append((start + x, likely[use], rows[use, x:y]))
    return found


def label(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, int, str, bool]]]:
    """The garbled spans of each text: begin, end, pair, what it was, whether nothing is lost."""
    jobs, owner = [], []
    for i, text in enumerate(texts):
        for begin, states, rows in _regions(model, text) if text else []:
            jobs.append(rows)
            owner.append((i, begin, states))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (i, begin, states), labelled in zip(owner, _viterbi(jobs, [model.enter[states] for *_, states in owner], model.leave)):
        for a, b, s in labelled:
            a, b, k = begin + a, begin + b, int(states[s])
            if spans[i] and spans[i][-1][1:] == (a, k):  # cut by the stretch
                a = spans[i].pop()[0]
            spans[i].append((a, b, k))
    return [[found for a, b, k in own if (found := _restored(model, text, a, b, k)) is not None] if own else [] for text, own in zip(texts, spans)]


def _restored(model: Model, text: str, a: int, b: int, k: int) -> tuple[int, int, int, str, bool] | None:
    """A labelled span without the plain characters at its ends, and what it was, if its likelihood favours that."""
    while a < b and text[a] < "\x80":
        a += 1
    while b > a and text[b - 1] < "\x80":
        b -= 1
    if a == b:
        return None
    _, was, as_, times, _ = PAIRS[k]
    span = text[a:b]
    if as_ == "utf-8":
        return a, b, k, span, False  # what couldn't be read is gone
    restored, whole = _inverse(span, was, as_, times)
    if times > 1 and not whole:  # once may have been enough
        once = next(i for i, p in enumerate(PAIRS) if p[1:4] == (was, as_, 1))
        again, whole_again = _inverse(span, was, as_, 1)
        if whole_again or again.count(LOST) < restored.count(LOST):
            k, restored, whole = once, again, whole_again
    if _evidence(model, span, restored, text[max(0, a - 1) : a], text[b : b + 1], k) <= 0:
        return None
    return a, b, k, restored, whole


def _count(model: Model | None):
    """How often each code point stands in each context in the texts, or in what the model labels clean, and the stretches that it labels garbled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STRETCHES + len(PAIRS) + 2, dtype=np.int64)
        for batch in batches:
            texts, keys = batch.column(0).to_pylist(), []
            for t, spans in zip(texts, label(model, texts) if model is not None else [[]] * len(texts)):
                if not t:
                    continue
                data = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                key = before(data).astype(np.int32) * np.int32(SHIFT) + data.astype(np.int32)
                if spans:
                    clean = np.ones(len(key), dtype=bool)
                    for a, b, k, *_ in spans:
                        clean[a:b] = False
                        seen[STRETCHES + k] += 1
                        seen[STRETCHES + len(PAIRS)] += min(b - a, STAY)
                        seen[STRETCHES + len(PAIRS) + 1] += b - a < STAY
                    key = key[clean]
                keys.append(key)
            if keys:
                found, n = np.unique(np.concatenate(keys), return_counts=True)
                seen[found] += n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["c", "n"])

    return run


def train(docs: DataFrame, text: str = "text", rounds: int = 2) -> Model:
    """The model of a corpus, trained by hard expectation maximization: emissions of the clean state and transitions.

    The first round counts all characters, each further one those that the last model labels clean, and the stretches that it doesn't. Only
    the counts, at most one for each code point and context, come to the driver.
    """
    model, counts = None, {}
    for _ in range(rounds):
        counted = docs.select(F.col(text).alias("text")).mapInArrow(_count(model), "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
        counts = dict.fromkeys(counts, 0) | {r["c"]: r["n"] for r in counted.collect()}
        model = Model(counts, labelled=model is not None)
    return model


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """The garbled records: ``key``, ``encodings`` (pairs, in order of appearance), ``n_garbled`` (characters), ``restorable`` and ``restored``.

    ``restored`` is the text with every labelled span undone as far as possible; ``restorable`` says that nothing in it is lost.
    Null, empty and clean texts give no rows; repeated rows give repeated rows; whole texts are labelled, however long.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text))  # code points by pairs: a few MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keep, pairs, sizes, wholes, texts = [], [], [], [], []
            all_texts = batch.column(1).to_pylist()
            for i, (t, spans) in enumerate(zip(all_texts, label(known, all_texts))):
                if spans:
                    keep.append(i)
                    pairs.append(list(dict.fromkeys(PAIRS[k][0] for _, _, k, _, _ in spans)))
                    sizes.append(sum(b - a for a, b, _, _, _ in spans))
                    wholes.append(all(w for *_, w in spans))
                    out, last = [], 0
                    for a, b, _, restored, _ in spans:
                        out += [t[last:a], restored]
                        last = b
                    texts.append("".join(out) + t[last:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(pairs, pa.list_(pa.string())), pa.array(sizes, pa.int32()), pa.array(wholes, pa.bool_()), pa.array(texts, pa.string())],
                names=["key", "encodings", "n_garbled", "restorable", "restored"],
            )

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, encodings array<string>, n_garbled int, restorable boolean, restored string")
    return out.withColumnRenamed("key", key)
