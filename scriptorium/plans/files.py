"""Tables written by the sinks and read back by the readers: nothing is lost or changed on the way."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.classes import SPACE
from scriptorium.plans.formats import sql_trim
from scriptorium.plans.registry import query, quoted
from scriptorium.session import scratch
from scriptorium.sources import readers, sinks
from scriptorium.sources.readers import table

_ROW = T.StructType([T.StructField("row_id", T.LongType()), *readers.LABELLED.fields, T.StructField("source", T.StringType())])


@query("SELECT doc_id, text, label, category, boundary FROM documents")
def csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    sinks.csv(table(spark, d, "documents").select("doc_id", "text", "label", "category", "boundary", "lang"), path, without=("lang",))
    return readers.csv(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), *readers.HYBRID.fields]))


@query("SELECT row_id, text, label, source FROM train UNION ALL SELECT row_id, text, label, source FROM val UNION ALL SELECT row_id, text, label, source FROM test")
def csv_appended(spark, d):
    path = scratch(spark, "appended")
    for name in ("train", "val", "test"):
        sinks.append(table(spark, d, name).select("row_id", "text", "label", "source", F.lit(True).alias("success")), path)
    return readers.csv(spark, path, _ROW)


@query("SELECT row_id, text, label, source FROM full_dataset")
def json_lines_round_trip(spark, d):
    path = scratch(spark, "json")
    sinks.json_lines(table(spark, d, "full_dataset").select("row_id", "text", "label", "source"), path)
    return readers.json_lines(spark, path, _ROW).filter("_corrupt is null").drop("_corrupt")


@query(f"SELECT {sql_trim('line')} AS text FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, {quoted(f'[^{SPACE}]')})")
def lines_scan(spark, d):
    path = scratch(spark, "lines")
    table(spark, d, "documents").filter("text is not null").select("text").write.text(path)
    return readers.lines(spark, path)


@query("SELECT 0 AS label, prompt AS text FROM parallel_dataset UNION ALL SELECT 1, text_content FROM parallel_dataset UNION ALL SELECT 1, topic FROM parallel_dataset")
def qa_scan(spark, d):
    path = scratch(spark, "qa")
    rows = table(spark, d, "parallel_dataset").select(F.col("topic").alias("question"), F.array("prompt").alias("human_answers"), F.array("text_content", "topic").alias("chatgpt_answers"), F.col("source_api").alias("source"))
    sinks.json_lines(rows, path)
    return readers.qa_texts(readers.qa(spark, path)).drop("id")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'none', 0")
def row_counts(spark, d):
    path = scratch(spark, "counts")
    for name in ("documents", "labels"):
        sinks.csv(table(spark, d, name), f"{path}/{name}.csv")
    return spark.createDataFrame([(name, readers.data_rows(spark, f"{path}/{name}.csv")) for name in ("documents", "labels", "none")], "name string, n bigint")
