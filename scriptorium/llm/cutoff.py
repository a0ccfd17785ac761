"""Texts that were cut off by a field limit or in transfer.

Two kinds of evidence are combined for each text. Lengths: for each source and each way of measuring (characters
without what was appended, bytes without it, all characters) a right-censored log-normal distribution is fitted by maximum likelihood;
lengths held by far more texts than it expects are candidate limits, and the censoring
posterior of a text at one is the part of these texts that the distribution doesn't expect. Endings: a logistic
model of how texts end, trained on this corpus without labels. Real texts teach it by their posterior: those at a limit are cut with that
probability, the others complete; the ends of inner lines are complete too, and texts cut
at random places inside sentences are not. The log odds of both are added.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import release, stage

# What is put in the place of cut text.
MARKERS = re.compile(r"(?:\s*(?:[\[【(（<〈《]\s*(?:\.{3,}|…+|更多|展开全文|阅读全文|查看全文|全文|省略|未完|more|read more|truncated|continued|cut)\s*[\]】)）>〉》]|(?:阅读全文|展开全文|查看全文|查看更多|更多内容|未完待续|read more|continue reading)\s*[>»]*)\s*)+$", re.I)
ELLIPSIS = re.compile(r"(?:…+|\.{3,}|。{3,})$")
TERMINAL = frozenset("。！？!?.;；~～」』”’\"')）]】》〉}>")
LIST = re.compile(r"(?:[-*+•]|\d+[.、)）]|[一二三四五六七八九十]+、)\s*")
# How units of markup and transfer formats begin; a text that breaks off behind one is cut.
OPENERS = ("`", "```\n", "（", "(", "《", "“", "‘", "**", "__", "<", "<b>", "[", "![", "[x](", "【", "{\"", "&", "&#", "\\", "\\n", "\\u", "\n- ", "\n| ", "\n1. ", "\n## ")
MARKED = ("……阅读全文", "[更多]", "(展开全文)", " [...]", "<省略>", "…", "...", "……")
BROKEN = {"entity": re.compile(r"&#?\w*$"), "escape": re.compile(r"\\[a-z]?[0-9a-f]{0,4}$"), "json": re.compile(r"\{\"[^}]*$"), "link": re.compile(r"\[[^\]\n]*(?:\]\([^)\n]*)?$"), "tag": re.compile(r"<[a-zA-Z/]*$"), "item": re.compile(r"\n(?:[-*+•|]|\d+[.、]|#+)\s*\S{0,2}$")}
WEIGHTS = 1 << 15
SAMPLE = 6_000  # rows that the model of endings is trained on
FEWEST = 5  # texts of one length that can make it a limit


def core(text: str) -> tuple[str, str]:
    """The text without what was appended to a cut (white space, a marker, dots, a broken character), and what that was."""
    bare = text.rstrip()
    kind = "space" if len(bare) < len(text) else ""
    if m := MARKERS.search(bare):
        kind, bare = "marker", bare[: m.start()]
    if m := ELLIPSIS.search(bare):
        kind, bare = kind if kind == "marker" else "dots", bare[: m.start()]
    if bare.endswith("�"):
        kind, bare = "broken", bare.rstrip("�")
    return bare, kind


def _kind(c: str) -> str:
    if c in TERMINAL:
        return "end"
    if c in "，、,：:；;—-（(“‘「『【[《<":
        return "mid"
    o = ord(c)
    if 0x3400 <= o <= 0x9FFF:
        return "han"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "letter"
    return unicodedata.category(c)[0]


def _line(line: str) -> str:
    if line.startswith("```"):
        return "fence"
    if line.startswith("|"):
        return "row"
    if line.startswith("#"):
        return "heading"
    if line.startswith(("——", "—", "--")):
        return "signature"
    if LIST.match(line):
        return "item"
    return "prose"


def features(text: str) -> list[int]:
    """Hashed features of how a text ends."""
    bare, kind = core(text)
    lines = [x for x in bare.split("\n") if x.strip()]
    last = lines[-1].strip() if lines else ""
    end = bare[-1:] or "-"
    shape = _line(last)
    kinds = _kind(end)
    before = [x.rstrip()[-1] in TERMINAL for x in lines[:-1][-12:]]
    closed = "none" if not before else "all" if all(before) else "no" if not any(before) else "some"
    pointed = "pointed" if re.search("[，。！？；,.!?]", last[:-1]) else "bare"
    size = min(6, len(last).bit_length())
    tail = last[-40:]
    open_ = [a for a, b in ("“”", "（）", "()", "[]", "{}", "【】", "《》", "「」", "『』") if last.count(a) > last.count(b)]
    if bare.count("```") % 2:
        open_.append("```")
    elif "```" not in last and last.count("`") % 2:
        open_.append("`")
    if last.count("**") % 2:
        open_.append("**")
    if re.search(r"<[a-zA-Z/]*$", tail) or len(re.findall(r"<[a-zA-Z]+>", last)) > len(re.findall(r"</[a-zA-Z]+>", last)):
        open_.append("<")
    found = [
        "k" + kinds, "a" + kind, f"ka{kinds}{kind}", "c" + end, "b" + bare[-2:], "t" + bare[-3:], f"ca{kind}{end}",
        f"s{shape}{kinds}", f"l{shape}{kinds}{pointed}{closed}", f"p{pointed}{kinds}", f"z{shape}{size}{kinds}", f"q{closed}{kinds}", f"e{shape}{end}",
        "w" + re.sub(r"\d+", "9", re.sub(r"[㐀-鿿]", "汉", tail[-6:])),
        *(f"o{x}" for x in open_), *(f"u{n}" for n, x in BROKEN.items() if x.search(text[-60:].rstrip())), f"n{min(2, len(open_))}{kinds}",
    ]
    if kinds == "letter":
        found.append("y" + (re.search(r"[^\W\d_]*$", bare[-12:]) or [""])[0].lower())
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % WEIGHTS for f in found]


def _inside(text: str, at: int) -> bool:
    """Whether a cut at ``at`` breaks a sentence or another unit."""
    return text[at - 1] not in TERMINAL and not text[at - 1].isspace() and not text[at].isspace() and text[at] not in TERMINAL and text[at] != "…"


def examples(text: str, posterior: float, seed: int) -> list[tuple[list[int], float, bool]]:
    """What a text teaches the model of endings: features, probability of being cut, whether it is a real end away from limits."""
    rng = np.random.default_rng(seed)
    rows = [(features(text), posterior, posterior == 0)]
    breaks = [m.start() for m in re.finditer(r"(?<=\S)\n", text)]
    rows += [(features(text[:at]), 0.0, False) for at in (rng.permutation(breaks)[:2].tolist() if breaks else ())]
    if len(text) > 20:
        places = [p for p in rng.integers(len(text) // 4, len(text), 8).tolist() if _inside(text, p)][:3]
        for at, how in zip(places, rng.integers(0, 4, 3).tolist()):
            more = int(rng.integers(0, 4))
            bare = (text[:at], text[:at] + MARKED[int(rng.integers(0, len(MARKED)))], text[:at] + ("�", " ", "\n")[more % 3])
            # Cut as it stands, with something put in its place, or behind the beginning of a unit.
            rows += [(features(cut), 1.0, False) for cut in (bare[min(how, 2)], text[:at] + OPENERS[int(rng.integers(0, len(OPENERS)))] + text[at : at + more])]
    return rows


def fit(rows: list[list[int]], cut: np.ndarray, real: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights of the model of endings: for the features, and last the constant. ``rows``, ``cut`` and ``real`` are those of ``examples``."""
    rng = np.random.default_rng(seed)
    w = np.zeros(WEIGHTS + 1, dtype=np.float32)
    if not len(rows):
        return w
    width = max(map(len, rows)) + 1
    index = np.full((len(rows), width), WEIGHTS, dtype=np.int64)  # the constant fills the rest
    on = np.zeros((len(rows), width), dtype=np.float32)
    for i, r in enumerate(rows):
        index[i, : len(r)] = r
        on[i, : len(r)] = 1.0
        on[i, -1] = 1.0
    y = cut.astype(np.float32)
    trust = np.ones(len(rows), dtype=np.float32)
    for _ in range(2):
        w = np.zeros(WEIGHTS + 1, dtype=np.float32)
        seen, mean = np.full(WEIGHTS + 1, 1e-6, dtype=np.float32), np.zeros(WEIGHTS + 1)
        for epoch in range(12):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 256):
                part = order[k : k + 256]
                # Some features are left out at random each time, so that each learns to speak for itself.
                at = index[part]
                used = on[part] * (rng.random((len(part), width), dtype=np.float32) > 0.35)
                used[:, -1] = 1.0
                p = 1 / (1 + np.exp(-np.clip((w[at] * used).sum(axis=1), -30, 30)))
                g = np.bincount(at.ravel(), weights=(((p - y[part]) * trust[part])[:, None] * used).ravel(), minlength=WEIGHTS + 1).astype(np.float32)
                g /= len(part)
                g += 2e-5 * w
                seen += g * g
                w -= 0.4 * g / np.sqrt(seen)
            if epoch >= 4:  # the mean of the later epochs depends less on the order of the examples
                mean += w / 8
        w = mean.astype(np.float32)
        z = (w[index] * on).sum(axis=1)
        trust = np.where(real & (z > 1.0), 0.0, 1.0).astype(np.float32)  # real ends that look cut are no examples of complete ones
    return w


def score(weights: np.ndarray, text: str) -> float:
    return float(weights[features(text)].sum() + weights[-1])


def _phi(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.atleast_1d(x)], dtype=float)


def censored_fit(x: np.ndarray, n: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of a normal distribution by maximum likelihood, where ``censored`` values are lower bounds.

    Expectation maximization: a censored value counts as its distribution's mean and square beyond the bound.
    """
    mu = float((x * n).sum() / n.sum())
    sigma = max(0.05, float(np.sqrt((n * (x - mu) ** 2).sum() / n.sum())))
    first, second = x.copy(), x * x
    bound = x[censored]
    for _ in range(rounds if len(bound) else 1):
        a = (bound - mu) / sigma
        hazard = np.exp(-0.5 * a * a) / math.sqrt(2 * math.pi) / np.maximum(1e-12, 1 - _phi(a))
        first[censored] = mu + sigma * hazard
        second[censored] = mu * mu + sigma * sigma + sigma * hazard * (bound + mu)
        new = float((n * first).sum() / n.sum())
        sigma, mu = max(0.05, math.sqrt(max(1e-6, float((n * second).sum() / n.sum()) - new * new))), new
    return mu, sigma


def _significant(held: np.ndarray, expected: np.ndarray, n_lengths: int) -> np.ndarray:
    """Where far more texts have a length than expected: so many that chance gives them to one of all lengths once in a million times (Chernoff)."""
    rarity = held * np.log(np.maximum(held, 1e-9) / expected) - held + expected
    return (held >= FEWEST) & (held > 2 * expected) & (rarity > math.log(n_lengths) + math.log(1e6))


def find_limits(lengths: np.ndarray, counts: np.ndarray, width: int) -> list[tuple[int, float, float, int]]:
    """Candidate limits of one source: (limit, texts up to ``width`` - 1 below it, how many of these are expected, distinct lengths).

    ``width`` is 1 for characters; for bytes 3, as a cut falls before the character that doesn't fit.
    """
    order = np.argsort(lengths, kind="stable")
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(float)
    total = counts.sum()
    if total < 2 * FEWEST:
        return []
    upto = np.concatenate([[0.0], np.cumsum(counts)])
    held = upto[1:] - upto[np.searchsorted(lengths, lengths - width, side="right")]
    limits: list[int] = []
    found: list[tuple[int, float, float, int]] = []
    while True:  # each round adds a length, or ends
        censored = np.zeros(len(lengths), dtype=bool)
        for v in limits:
            censored |= (lengths > v - width) & (lengths <= v)
        mu, sigma = censored_fit(np.log(np.maximum(lengths, 1)), counts, censored)
        edge = _phi((np.log(np.maximum(lengths + 0.5, 0.5)) - mu) / sigma) - _phi((np.log(np.maximum(lengths + 0.5 - width, 0.5)) - mu) / sigma)
        expected = np.maximum(total * edge, 0.02 * width)
        over = np.where(censored, 0.0, held)
        good = _significant(over, expected, len(lengths))
        found = [(v, float(held[lengths == v][0]), float(expected[lengths == v][0]), len(lengths)) for v in limits]
        if not good.any():
            break
        limits.append(int(lengths[np.argmax(np.where(good, over / np.sqrt(expected), 0))]))
    return found


#: Ways of measuring and how far below a limit a cut may fall.
MEASURES = {"core_chars": 1, "core_bytes": 3, "chars": 1}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, text -> source and the lengths by MEASURES."""
    for batch in batches:
        sizes = [_sizes(t, core(t)[0]) for t in batch.column(1).to_pylist()]
        columns = list(zip(*sizes)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int32()) for c in columns)], names=["source", *MEASURES])


def _sizes(text: str, bare: str) -> tuple[int, int, int]:
    return len(bare), len(bare.encode("utf-8", "surrogatepass")), len(text)


def _limits_of(group: pd.DataFrame) -> pd.DataFrame:
    measure = group["measure"].iloc[0]
    rows = [(group["source"].iloc[0], measure, *f) for f in find_limits(group["length"].to_numpy(), group["n"].to_numpy(), MEASURES[measure])]
    return pd.DataFrame(rows, columns=["source", "measure", "length_limit", "n_at", "expected", "n_lengths"])


def _still_limits(group: pd.DataFrame) -> pd.DataFrame:
    good = group[[bool(_significant(np.array([n]), np.array([e]), k)[0]) for n, e, k in zip(group["n"], group["expected"], group["n_lengths"])]]
    return pd.DataFrame({"source": good["source"], "measure": good["measure"], "length_limit": good["length_limit"], "n_at": good["n"].astype(float), "posterior": 1 - np.minimum(1.0, good["expected"] / good["n"])})


def limits(measured: DataFrame) -> DataFrame:
    """``source``, ``measure``, ``length_limit``, ``n_at``, ``posterior``: the limits of every source.

    What is appended to texts cut at one length, or taken off for it, makes neighbouring lengths frequent too. So each text at candidates of several
    measures counts only for the one that most texts have, and a candidate that isn't far more frequent than expected by these texts alone is none.
    What a group gathers is a histogram: one row for each length, however many texts have it.
    """
    lengths = measured.select("source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES))).alias("m")).select("source", "m.*")
    histogram = lengths.groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    candidates = stage(histogram.groupBy("source", "measure").applyInPandas(_limits_of, "source string, measure string, length_limit int, n_at double, expected double, n_lengths int"), "candidates")
    rows = measured
    for measure, width in MEASURES.items():
        own = candidates.filter(F.col("measure") == measure).select(F.col("source").alias("s"), F.explode(F.sequence(F.col("length_limit") - width + 1, "length_limit")).alias("held"), F.struct("n_at", F.lit(measure).alias("measure"), "length_limit").alias("limit"))
        own = own.groupBy("s", "held").agg(F.max("limit").alias(f"at_{measure}"))
        rows = rows.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col(measure) == F.col("held")), "left").drop("s", "held")
    counted = rows.withColumn("at", F.greatest(*(f"at_{m}" for m in MEASURES))).filter("at is not null").groupBy("source", "at.measure", "at.length_limit").agg(F.count("*").alias("n"))
    known = candidates.select(F.col("source").alias("s"), F.col("measure").alias("m"), F.col("length_limit").alias("l"), "expected", "n_lengths")
    counted = counted.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m")) & (F.col("length_limit") == F.col("l")))
    return stage(counted.select("source", "measure", "length_limit", "n", "expected", "n_lengths").groupBy("source").applyInPandas(_still_limits, "source string, measure string, length_limit int, n_at double, posterior double"), "limits")


def _posterior(text: str, bare: str, limits_: list[dict] | None) -> float:
    """The largest censoring posterior of a text at its source's limits."""
    if not limits_:
        return 0.0
    size = dict(zip(MEASURES, _sizes(text, bare)))
    return max((x["posterior"] for x in limits_ if x["length_limit"] - MEASURES[x["measure"]] < size[x["measure"]] <= x["length_limit"]), default=0.0)


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, text, limits of the source -> the examples."""
    for batch in batches:
        rows = [e for h, text, own in zip(*(c.to_pylist() for c in batch.columns)) for e in examples(text, _posterior(text, core(text)[0], own), h & 0xFFFFFFFF)]
        found, cut, real = list(zip(*rows)) or ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(cut, pa.float64()), pa.array(real, pa.bool_())], names=["features", "cut", "real"])


def _judge(weights, prior: float):
    """key, source, text, limits of the source -> key, source, log odds, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            z = []
            for text, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                chance = max(prior, min(0.98, _posterior(text, core(text)[0], own)))
                z.append(score(w, text) + math.log(chance / (1 - chance)))
            odds_ = np.array(z, dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odds_), pa.array(odds_ > 0)], names=["key", "source", "log_odds", "cut"])

    return run


def drawn(rows: DataFrame, sample: int, n_rows: int) -> DataFrame:
    """``h``, ``source``, ``text`` of at most ``sample`` of the ``n_rows`` ``rows`` (``key``, ``source``, ``text``): those of least hash of key and text.

    A repeated row counts once. Only hashes are ordered, and of these only half as many again as needed, wherever they lie; the texts stay where they are.
    """
    part = min(1.0, 1.5 * sample / max(1, n_rows))
    hashed = rows.withColumn("h", F.xxhash64("key", "text")).filter(F.col("h") <= min(2**63 - 1, int(-(2**63) + part * 2**64)))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return hashed.filter(F.col("h") <= last if last is not None else F.lit(False)).groupBy("h").agg(F.first("source").alias("source"), F.first("text").alias("text"))


def detect(docs: DataFrame, key: str = "row_id", text: str = "text", source: str = "source", sample: int = SAMPLE, prior: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """One row for each text that isn't blank (``key``, ``source``, ``log_odds``, ``cut``), and the limits found.

    Null and blank texts give no rows; a null source is a source of its own; repeated rows give repeated rows. The model
    of endings is fitted on at most ``sample`` rows, drawn by a hash of key and text, whose features alone come to the driver; everything else uses all. ``prior`` is the
    share of cut texts away from any limit. An empty table gives empty results.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).filter(F.col("text").rlike(r"\S"))
    measured = stage(rows.select("source", "text").mapInArrow(_measure, "source string, " + ", ".join(f"{m} int" for m in MEASURES)), "measured")
    found = limits(measured)
    own = found.groupBy(F.col("source").alias("s")).agg(F.collect_list(F.struct("measure", "length_limit", "posterior")).alias("limits"))  # as many as are significant
    with_limits = lambda d: d.join(own, F.col("source").eqNullSafe(F.col("s")), "left")

    taught = with_limits(drawn(rows, sample, measured.count())).select("h", "text", "limits").mapInArrow(_teach, "features array<int>, cut double, real boolean").toArrow()  # 9 rows of some 30 numbers for each text of the sample
    weights = fit(taught["features"].to_pylist(), taught["cut"].to_numpy(), taught["real"].to_numpy())
    release(measured)
    judged = with_limits(rows).select("key", "source", "text", "limits").mapInArrow(_judge(spark.sparkContext.broadcast(weights), prior), f"key {kind}, source string, log_odds double, cut boolean")
    return judged.withColumnRenamed("key", key), found


def report(docs: DataFrame, **how) -> DataFrame:
    """Per source: ``n_texts`` that aren't blank, ``n_cut``, ``cut_share`` and the limits found (``limits``, as measure and length)."""
    judged, found = detect(docs, **how)
    named = found.select("source", F.concat_ws(" ", "measure", "length_limit").alias("name")).groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_set("name")).alias("limits"))
    shares = judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    shares = shares.join(named, F.col("source").eqNullSafe(F.col("s")), "left")
    return shares.select("source", "n_texts", "n_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("cut_share"), F.coalesce("limits", F.array().cast("array<string>")).alias("limits"))
