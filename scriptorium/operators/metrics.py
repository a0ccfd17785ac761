"""Metrics of predictions. Scores are ordinary columns; everything is aggregation, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import maths
from scriptorium.operators import ranges


def r6(c):
    return F.round(c, 6)


def confusion_columns(pred: Column, label: Column) -> list[Column]:
    return [F.count_if((pred == p) & (label == y)).alias(n) for n, p, y in (("tp", 1, 1), ("fp", 1, 0), ("tn", 0, 0), ("fn", 0, 1))]


def confusion(rows: DataFrame, by: list[str] = [], pred: str = "pred", label: str = "label") -> DataFrame:  # noqa: B006
    """Counts and accuracy, precision, recall, F1 (0 where undefined), and accuracy within each class, by group."""
    g = rows.groupBy(*by) if by else rows.groupBy()
    c = g.agg(*confusion_columns(F.col(pred), F.col(label)))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return c.select(*by, "tp", "fp", "tn", "fn", r6(maths.safe(tp + tn, tp + fp + tn + fn)).alias("accuracy"), r6(maths.safe(tp, tp + fp)).alias("precision"), r6(maths.safe(tp, tp + fn)).alias("recall"), r6(maths.safe(2 * tp, 2 * tp + fp + fn)).alias("f1"), r6(maths.safe(tn, tn + fp)).alias("human_accuracy"))


def report(rows: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """Per class precision, recall, F1 and support, then their macro and weighted means."""
    c = rows.agg(*confusion_columns(F.col(pred), F.col(label)))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    one = lambda y, a, p, q: F.struct(F.lit(y).alias("class"), maths.safe(a, a + p).alias("precision"), maths.safe(a, a + q).alias("recall"), maths.safe(2 * a, 2 * a + p + q).alias("f1"), (a + q).alias("support"))
    each = c.select(F.explode(F.array(one("0", tn, fn, fp), one("1", tp, fp, fn))).alias("r")).select("r.*")
    mean = lambda name, w: each.agg(*[F.coalesce(F.try_divide(F.sum(F.col(m) * w), F.sum(w)), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit(name).alias("class"), "precision", "recall", "f1", "support")
    out = each.unionByName(mean("macro", F.lit(1.0))).unionByName(mean("weighted", F.col("support").cast("double")))
    return out.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


def by_bin(rows: DataFrame, edges: list[float], length: Column, pred: str = "pred", label: str = "label") -> DataFrame:
    """``confusion`` by length bin; empty bins are left out."""
    b = rows.withColumn("bin", maths.bin_of(length, edges, lowest=True)).filter("bin is not null")
    return confusion(b, ["bin"], pred, label).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).withColumn("range", maths.bin_label(F.col("bin"), edges))


def bin_variance(bins: DataFrame) -> DataFrame:
    """Mean and population variance of accuracy and F1 over the bins, each bin counting once, and a grade."""
    v = bins.agg(F.avg("accuracy").alias("mean_accuracy"), F.var_pop("accuracy").alias("var_accuracy"), F.avg("f1").alias("mean_f1"), F.var_pop("f1").alias("var_f1"))
    x = F.col("var_accuracy")
    grade = F.when(x < 0.01, "excellent").when(x < 0.03, "good").when(x < 0.05, "fair").otherwise("poor")
    return v.select(*[r6(c).alias(c) for c in v.columns], grade.alias("grade"))


def roc(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """A point for each distinct score: everything at or above it is called positive.

    Aggregated by score first; the cumulative sums run within ranges of about as many scores each, plus the sums of the ranges above, so
    no task sorts all scores, wherever they pile up.
    """
    by = rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    by = ranges.ranged(by, "threshold")
    j = ranges.joined(by, ranges.offsets(by, [], p=F.col("p"), n=F.col("n")), [])
    inside = Window.partitionBy("range").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda c: F.col(f"all_{c}") - F.col(f"before_{c}") - F.coalesce(F.sum(c).over(inside), F.lit(0))
    return j.select("threshold", r6(maths.safe(above("p"), F.col("all_p"))).alias("tpr"), r6(maths.safe(above("n"), F.col("all_n"))).alias("fpr"))


def auc(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Area under the curve by the rank sum with average ranks for ties; null for a single class. Sorted by ranges, as in ``roc``."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    by = ranges.ranged(by, "s")
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    j = ranges.joined(by, ranges.offsets(by, [], n=F.col("n")), []).withColumn("ln", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("before_n"))
    u = F.sum((F.col("p") * (2 * F.col("ln") + F.col("n"))).cast("decimal(38,0)"))
    return j.agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), u.alias("u")).select("n_pos", "n_neg", r6(F.try_divide(F.col("u").cast("double"), 2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def score_stats(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Count, range, mean, exact median and deviation of each group; no task holds all values of one."""
    c = F.col(score)
    stats = rows.groupBy(*by).agg(F.count(c).alias("n"), r6(F.min(c)).alias("min"), r6(F.max(c)).alias("max"), r6(F.avg(c)).alias("mean"), r6(F.stddev_pop(c)).alias("std"))
    middle = ranges.medians(rows, score, by).select(*[F.col(b).alias(f"__{b}") for b in by], r6("median").alias("median"))
    return stats.join(middle, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], "left").drop(*[f"__{b}" for b in by])


def histogram(rows: DataFrame, value: Column, low: Column | float, high: Column | float, bins: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Counts by equal-width bin (0, 1, ...); the upper edge belongs to the last bin."""
    low, high = (F.lit(float(x)) if isinstance(x, (int, float)) else x for x in (low, high))
    width = (high - low) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.floor((value - low) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def standardized(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less the training mean, by the training population deviation (1 for a constant column)."""
    fit = train.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(fit))  # one row
    for c in columns:
        s = F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
        out = out.withColumn(c, r6((F.col(c) - F.col(f"__m_{c}")) / s))
    return out.drop(*[x for c in columns for x in (f"__m_{c}", f"__s_{c}")])
