"""From predictions to verdicts: decision, boundary sentence and sentence attribution, without any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import maths, text
from scriptorium.operators import ranges


def gated(queries: DataFrame, rows: DataFrame, id: str, vector: str, least: float = 0.85, block: int = 4096) -> DataFrame:
    """The most similar other row of each query by cosine (ties go to the lower id), and whether it passes the gate: ``query``, ``match``, ``similarity``, ``kept``.

    The queries are taken in blocks of that many, which bounds what is broadcast; each block is one pass over the rows, and each partition keeps one match a query. Null and
    zero vectors are similar to none; ids and vectors are not gathered anywhere else.
    """
    numbered = ranges.numbered(queries.filter(F.col(vector).isNotNull()).select(F.col(id).alias("query"), F.col(vector).cast("array<double>").alias("q")), "query")
    n = numbered.agg(F.max("n")).first()[0]
    best = None
    for k in range(0 if n is None else n // block + 1):
        part = numbered.filter((F.col("n") >= k * block) & (F.col("n") < (k + 1) * block)).select("query", "q")  # `block` rows at most
        pairs = rows.filter(F.col(vector).isNotNull()).select(F.col(id).alias("match"), F.col(vector).cast("array<double>").alias("v")).join(F.broadcast(part), F.col("match") != F.col("query"))
        s = pairs.select("query", "match", F.round(maths.cosine(F.col("q"), F.col("v")), 5).alias("similarity")).filter("similarity is not null")
        own = s.groupBy("query").agg(F.max(F.struct("similarity", (-F.col("match")).alias("m"))).alias("b")).select("query", (-F.col("b.m")).alias("match"), F.col("b.similarity").alias("similarity"))
        best = own if best is None else best.unionByName(own)
    if best is None:
        best = queries.sparkSession.createDataFrame([], "query bigint, match bigint, similarity double")
    return best.withColumn("kept", F.col("similarity") >= least)


def decided(rows: DataFrame, prob_ai: str = "prob_ai", boundary: str = "boundary", threshold: int = 80) -> DataFrame:
    """Adds ``ai_percent``, ``human_percent``, ``label_name``, ``confidence``, ``boundary_char`` and ``kind``.

    Above the threshold (in truncated percent) a text is 'ai' or 'human', else 'mixed'. The boundary is looked up unless a text is
    confidently human; one that is found makes it 'mixed', and without one an undecided text takes the likelier side.
    """
    p = F.col(prob_ai)
    ai, human = maths.percent(p), maths.percent(1 - p)
    first = F.when(ai > threshold, "ai").when(human > threshold, "human").otherwise("mixed")
    label = F.when(p > 0.5, "AI").otherwise("Human")
    out = rows.withColumn("ai_percent", ai).withColumn("human_percent", human).withColumn("label_name", label).withColumn("confidence", F.greatest(p, 1 - p) * 100).withColumn("__first", first)
    looked = F.when(F.col("__first").isin("ai", "mixed") | (F.col("label_name") == "AI"), F.col(boundary).cast("int"))
    out = out.withColumn("boundary_char", looked)
    kind = F.when(F.col("boundary_char").isNotNull(), "mixed").when(F.col("__first") == "mixed", F.when(p > 1 - p, "ai").otherwise("human")).otherwise(F.col("__first"))
    return out.withColumn("kind", kind).drop("__first")


def boundary_sentence(sentences: Column, boundary: Column) -> Column:
    """The index of the sentence whose running range holds the boundary; null without one. Sentences are kept with their blanks dropped."""
    ends = F.aggregate(
        sentences,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit")),
        lambda s, x: F.struct((s["i"] + 1).alias("i"), (s["at"] + F.length(x)).alias("at"), F.when((boundary >= s["at"]) & (boundary < s["at"] + F.length(x)), s["i"]).otherwise(s["hit"]).alias("hit")),
    )
    return ends["hit"]


def attributed(rows: DataFrame, id: str, text_: str = "text", prob_ai: str = "prob_ai", boundary: str = "boundary") -> DataFrame:
    """One row a sentence: ``idx``, ``sentence``, ``is_ai``."""
    d = decided(rows, prob_ai, boundary).withColumn("sentences", text.sentences(F.col(text_)))
    d = d.withColumn("at", boundary_sentence(F.col("sentences"), F.col("boundary_char")))
    each = d.select(id, "kind", "at", "ai_percent", F.posexplode("sentences").alias("idx", "sentence"))
    is_ai = F.when(F.col("kind") == "ai", True).when(F.col("kind") == "human", False).when(F.col("at").isNotNull(), F.col("idx") >= F.col("at")).otherwise(F.col("ai_percent") > 50)
    return each.select(id, "idx", "sentence", is_ai.alias("is_ai"))


def response(rows: DataFrame, id: str, text_: str = "text", prob_ai: str = "prob_ai", boundary: str = "boundary") -> DataFrame:
    """The nested verdict of each text: kind, percentages, boundary, sentences, risk flags and register."""
    d = decided(rows, prob_ai, boundary).withColumn("s", text.sentences(F.col(text_)))
    d = d.withColumn("at", boundary_sentence(F.col("s"), F.col("boundary_char")))
    is_ai = lambda i: F.when(F.col("kind") == "ai", True).when(F.col("kind") == "human", False).when(F.col("at").isNotNull(), i >= F.col("at")).otherwise(F.col("ai_percent") > 50)
    each = F.transform("s", lambda x, i: F.struct(x.alias("text"), is_ai(i).alias("isAI"), F.col("confidence").alias("confidence")))
    return d.select(id, F.col("kind").alias("type"), "confidence", F.col("human_percent").alias("humanPercentage"), F.col("ai_percent").alias("aiPercentage"), F.col("at").alias("boundary"), each.alias("sentences"), text.risk_flags(F.col(text_), F.col("confidence"), F.col("at"), F.col("kind")).alias("riskFlags"), text.register(F.col(text_)).alias("domainHint"))
