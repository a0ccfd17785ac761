"""Audits of a corpus: markup and length bias, quality, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import markup, maths
from scriptorium.functions.text import language, special_ratio
from scriptorium.operators.metrics import confusion_columns


def r6(c):
    return F.round(c, 6)


def _rate(cond, of):
    return F.avg(F.when(of, cond.cast("double")))


def format_bias(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One row: how often each class has markup, the difference, and how well "has markup" alone predicts the class."""
    m = rows.select(F.col(label).alias("y"), markup.has_markup(F.col(text)).alias("md"))
    a = m.agg(_rate(F.col("md"), F.col("y") == 1).alias("ai"), _rate(F.col("md"), F.col("y") == 0).alias("human"), *confusion_columns(F.col("md").cast("int"), F.col("y")))
    a = a.withColumn("ai", F.coalesce("ai", F.lit(0.0))).withColumn("human", F.coalesce("human", F.lit(0.0)))
    bias = F.abs(F.col("ai") - F.col("human"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return a.select(
        r6(F.col("ai")).alias("ai_md_rate"), r6(F.col("human")).alias("human_md_rate"), r6(bias).alias("bias"),
        r6(maths.safe(F.col("tp") + F.col("tn"), n)).alias("accuracy"), r6(maths.safe(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        r6(maths.safe(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), r6(maths.safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
        "tp", "fp", "tn", "fn", F.when(bias < 0.05, "pass").when(bias < 0.15, "warning").otherwise("fail").alias("status"),
    )


def debiased(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Markup is stripped from the texts of class 1 that have any; all others stay as they are."""
    strip = (F.col(label) == 1) & markup.has_markup(F.col(text))
    return rows.withColumn(text, F.when(strip, markup.strip_markup(F.col(text))).otherwise(F.col(text)))


def rebalanced(rows: DataFrame, id: str, text: str = "text", label: str = "label", share: float = 0.35, seed: int | str = 42) -> DataFrame:
    """Each class gets markup in floor(share * n) of its texts, as far as dressing gives any.

    Of the texts that have markup, those first in hash order keep it and the others are stripped; if there are too few, the first
    of the plain texts are dressed with a title. Null labels are a class of their own.
    """
    from scriptorium.operators.sampling import ranked

    marked = ranked(rows.withColumn("__md", markup.has_markup(F.col(text))), id, [label, "__md"], seed, "__rank")
    sizes = marked.groupBy(F.col(label).alias("__y")).agg(F.floor(F.count("*") * share).alias("__goal"), F.count_if("__md").alias("__have"))
    j = marked.join(sizes, F.col(label).eqNullSafe(F.col("__y")), "left")
    t = F.col(text)
    new = F.when(F.col("__md") & (F.col("__rank") > F.col("__goal")), markup.strip_markup(t)).when(~F.col("__md") & (F.col("__rank") <= F.col("__goal") - F.col("__have")), F.concat(F.lit("## "), t)).otherwise(t)
    return j.withColumn(text, new).drop("__md", "__rank", "__y", "__goal", "__have")


def debias_effect(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Bias and rule accuracy before and after, from one scan, and a verdict."""
    after = F.when((F.col(label) == 1) & F.col("before"), markup.has_markup(markup.strip_markup(F.col(text)))).otherwise(F.col("before"))
    m = rows.withColumn("before", markup.has_markup(F.col(text))).select(F.col(label).alias("y"), "before", after.alias("after"))
    parts = []
    for t in ("before", "after"):
        parts += [F.coalesce(_rate(F.col(t), F.col("y") == 1), F.lit(0.0)).alias(f"ai_{t}"), F.coalesce(_rate(F.col(t), F.col("y") == 0), F.lit(0.0)).alias(f"human_{t}"), F.avg((F.col(t).cast("int") == F.col("y")).cast("double")).alias(f"acc_{t}")]
    a = m.agg(*parts)
    b0, b1 = F.abs(F.col("ai_before") - F.col("human_before")), F.abs(F.col("ai_after") - F.col("human_after"))
    verdict = F.when((b1 < 0.05) & (F.col("acc_after") < 0.5), "good").when((b1 < 0.10) & (F.col("acc_after") < 0.6), "fair").otherwise("poor")
    return a.select(r6(b0).alias("bias_before"), r6(b1).alias("bias_after"), r6(b0 - b1).alias("bias_drop"), r6("acc_before").alias("rule_acc_before"), r6("acc_after").alias("rule_acc_after"), verdict.alias("verdict"))


def type_stats(rows: DataFrame, text: str = "text") -> DataFrame:
    """For each of the eleven kinds the number of texts that have it and their percentage; 0 for an empty table."""
    total = F.count("*")
    a = rows.agg(total.alias("total"), *[F.count_if(markup.has_kind(F.col(text), k)).alias(k) for k in markup.KINDS])
    rows_ = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in markup.KINDS])
    return a.select("total", F.explode(rows_).alias("r")).select(F.col("r.kind").alias("kind"), F.col("r.n").alias("n"), r6(maths.safe(F.col("r.n") * 100, F.col("total"))).alias("percent"))


def quality(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """The composite score of a data set with its parts, in one row; null parts for an empty table."""
    t = F.col(text)
    length = F.length(t).cast("double")
    a = rows.select(t.alias("t"), F.col(label).alias("y"), length.alias("n"), special_ratio(t).alias("special"), language(t).alias("lang"))
    one = a.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("t").isNull()).alias("text_missing"), F.count_if(F.col("y").isNull()).alias("label_missing"), F.avg("n").alias("mean_length"),
        F.count_if(F.col("special") > 0.1).alias("high_special"), F.avg("special").alias("mean_special"), F.count_if(F.col("lang") == "chinese").alias("n_chinese"),
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"),
    )
    distinct = rows.filter(t.isNotNull()).select(F.md5(t).alias("h")).groupBy("h").count().agg(F.count("*").alias("n_distinct"))
    j = one.crossJoin(F.broadcast(distinct))  # one row each
    share = lambda c: maths.safe(F.col(c), F.col("n_rows"))
    j = j.withColumn("missing", share("text_missing")).withColumn("dup", maths.safe(F.col("n_rows") - F.col("text_missing") - F.col("n_distinct"), F.col("n_rows")))
    j = j.withColumn("balance", F.when((F.col("n0") == 0) | (F.col("n1") == 0), 1.0).otherwise(F.least("n0", "n1") / F.greatest("n0", "n1")))
    j = j.withColumn("hs", share("high_special")).withColumn("zh", share("n_chinese"))
    score = 100 - 30 * F.col("missing") - 25 * F.col("dup") + 20 * (F.col("balance") - 0.5) - 15 * F.col("hs") + F.when(F.col("zh") > 0.8, 10 * (F.col("zh") - 0.8)).otherwise(0.0)
    score = maths.clamp(score - F.when((F.col("mean_length") < 50) | (F.col("mean_length") > 2000), 10).otherwise(0), 0.0, 100.0)
    j = j.withColumn("score", score)
    level = F.when(F.col("score") >= 80, "high").when(F.col("score") >= 60, "medium").otherwise("low")
    return j.select("n_rows", r6("missing").alias("text_missing_rate"), r6(share("label_missing")).alias("label_missing_rate"), r6("dup").alias("duplicate_rate"), r6("balance").alias("balance_ratio"), r6("hs").alias("high_special_rate"), r6("mean_special").alias("mean_special_ratio"), r6("zh").alias("chinese_rate"), r6("mean_length").alias("mean_length"), r6("score").alias("score"), level.alias("level"))


def length_distribution(rows: DataFrame, by: str, length) -> DataFrame:
    """Mean, median, sample deviation, extremes and quartiles (interpolated) of a length, by group.

    The exact percentiles aggregate counts by distinct length, of which there are few.
    """
    n = rows.select(F.col(by), length.cast("double").alias("n")).filter("n is not null")
    q = lambda p: F.percentile("n", F.lit(p))
    return n.groupBy(by).agg(F.count("*").alias("count"), r6(F.avg("n")).alias("mean"), r6(q(0.5)).alias("median"), r6(F.stddev_samp("n")).alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), r6(q(0.25)).alias("q25"), r6(q(0.75)).alias("q75"))


def length_balance(rows: DataFrame, edges: list[float], text: str = "text", label: str = "label") -> DataFrame:
    """By length bin the texts of each class, their ratio and whether it is balanced."""
    b = rows.select(maths.bin_of(F.length(text), edges).alias("bin"), F.col(label).alias("y")).filter("bin is not null and y is not null")
    c = b.groupBy("bin").agg(F.count_if(F.col("y") == 1).alias("n_ai"), F.count_if(F.col("y") == 0).alias("n_human"))
    ratio = F.try_divide(F.col("n_human").cast("double"), F.col("n_ai").cast("double"))
    status = F.when(F.col("n_ai") == 0, "no_ai").when(F.col("n_human") == 0, "no_human").when(ratio.between(0.8, 1.2), "balanced").otherwise("unbalanced")
    return c.select("bin", maths.bin_label(F.col("bin"), edges).alias("range"), "n_ai", "n_human", r6(ratio).alias("ratio"), status.alias("status"))
