"""Numeric functions of evaluation and training data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax2(a: Column, b: Column, temperature: float = 0.8165, floor: float = 1e-6) -> tuple[Column, Column]:
    """Two logits as probabilities, in the form that can't overflow."""
    t = max(temperature, floor)
    top = F.greatest(a, b)
    x, y = F.exp((a - top) / t), F.exp((b - top) / t)
    return x / (x + y), y / (x + y)


def percent(p: Column) -> Column:
    """Truncated percent; a pair may sum to 99."""
    return F.floor(p * 100).cast("int")


def true_probability(p: Column, label: Column) -> Column:
    return F.when(label == 1, p).otherwise(1 - p)


def length_weight(length: Column, alpha: float = 0.3, most: float = 512.0) -> Column:
    """1 for long texts up to 1 + alpha for empty ones."""
    return 1.0 + alpha * (1.0 - F.least(F.greatest(length / F.lit(most), F.lit(0.0)), F.lit(1.0)))


def weighted_loss(p: Column, label: Column, length: Column, alpha: float = 0.3) -> Column:
    return -F.ln(F.greatest(true_probability(p, label), F.lit(1e-12))) * length_weight(length, alpha)


def adaptive_loss(p: Column, label: Column, length: Column, alpha: float = 0.3, boost: float = 0.2) -> Column:
    return weighted_loss(p, label, length, alpha) * (1.0 + boost * (1.0 - true_probability(p, label)))


def focal_loss(p: Column, label: Column, length: Column, alpha: float = 0.3, gamma: float = 2.0) -> Column:
    t = true_probability(p, label)
    return F.pow(1.0 - t, F.lit(gamma)) * -F.ln(t + 1e-8) * length_weight(length, alpha)


def joint_loss(a: Column, b: Column, wa: float = 1.0, wb: float = 0.5) -> Column:
    return wa * a + wb * b


def vote(*scores: Column, weights: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)) -> Column:
    out = F.lit(0.0)
    for s, w in zip(scores, weights):
        out = out + s * w
    return out


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance by the length of ``a``."""
    return F.try_divide(F.levenshtein(a, b).cast("double"), F.length(a).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def safe(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bin_of(value: Column, edges: list[float], lowest: bool = False) -> Column:
    """0, 1, ...: the right-closed bin of ``value``, or null outside; the first bin holds its left edge if ``lowest``."""
    out = F
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        above = (value >= a) if lowest and i == 0 else (value > a)
        out = out.when(above & (value <= b), i)
    return out


def bin_label(index: Column, edges: list[float]) -> Column:
    names = [f"{int(a)}-{'inf' if b == float('inf') else int(b)}" for a, b in zip(edges, edges[1:])]
    return F.get(F.array(*map(F.lit, names)), index)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
