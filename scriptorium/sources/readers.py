"""Readers with explicit schemas. None infers a schema from data unless asked to."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())])
HYBRID = T.StructType([*LABELLED.fields, T.StructField("category", T.StringType()), T.StructField("boundary", T.IntegerType())])
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())]))
HYBRID_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("text_id", "text", "category")] + [T.StructField("label", T.IntegerType()), T.StructField("source_model", T.StringType()), T.StructField("api", T.StringType()), T.StructField("boundary", T.IntegerType()), T.StructField("spans", SPAN)])
QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("human_answers", T.ArrayType(T.StringType())), T.StructField("chatgpt_answers", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())])
# The configurations of the question-and-answer corpus.
QA_CONFIGS = ("all", "baike", "open_qa", "nlpcc_dbqa", "finance", "medicine", "law", "psychology")
# Column names that stand for the text and for the label.
TEXT_NAMES = ("text", "content", "文本", "内容")
LABEL_NAMES = ("label", "target", "标签", "类别")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType, line_feeds: bool = True) -> DataFrame:
    """CSV with a header, quoted line feeds and doubled quotes; a leading byte order mark is dropped.

    Columns are found by name, missing ones are null, unknown ones are left out. An empty field is null, a quoted empty one an empty text. Fields may hold line feeds, so that a file is
    read by one task; where none does, ``line_feeds=False`` lets large files be split.
    """
    # What isn't quoted and empty is null, what is quoted and empty is an empty text: the null mark is one that no text has.
    raw = spark.read.csv(path, header=True, multiLine=line_feeds, escape='"', inferSchema=False, nullValue="\x00")
    names = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[(F.col(f"`{names[f.name]}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Files that hold one JSON array each; an array can't be split, so a file is read by one task. Large data belongs into ``json_lines``."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A JSON object a line; a line that is none has its text in ``_corrupt``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def globbed(spark: SparkSession, pattern: str, schema: T.StructType, skip: str | None = None) -> DataFrame:
    """JSON arrays of all files that match, with ``path``; files whose name matches ``skip`` (such as own output) are left out."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.filter(~F.element_at(F.split("path", "/"), -1).rlike(skip)) if skip else rows


def qa(spark: SparkSession, path: str, config: str = "all") -> DataFrame:
    """Questions with both kinds of answers; ``id`` is the line's ordinal, ``source`` exists in 'all' only.

    Lines are numbered within the splits of the files, and the splits' counts, of which there are as many as tasks, give each its first number.
    """
    if config not in QA_CONFIGS:
        raise ValueError(f"unknown configuration: {config}")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33))
    counts = lines.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = lines.join(F.broadcast(first), "task").select(F.from_json("value", QA).alias("r"), (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
    return rows.select("id", "r.question", "r.human_answers", "r.chatgpt_answers", *(["r.source"] if config == "all" else []))


def qa_texts(rows: DataFrame) -> DataFrame:
    """An answer a row, labelled 0 (human) or 1 (AI)."""
    both = F.array(F.struct(F.lit(0).alias("label"), F.col("human_answers").alias("a")), F.struct(F.lit(1).alias("label"), F.col("chatgpt_answers").alias("a")))
    return rows.select("id", F.explode(both).alias("b")).select("id", "b.label", F.explode("b.a").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A trimmed text for each line that isn't blank."""
    from scriptorium.functions.markup import strip_space

    return spark.read.text(path).select(strip_space(F.col("value")).alias("text")).filter("text <> ''")


def _files(spark: SparkSession, folder: str, below: bool) -> Iterator[str]:
    """The files in a folder, or below it, of whatever file system its address names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, below)
    while found.hasNext():
        yield found.next().getPath().toString()


def discovered(spark: SparkSession, folder: str, kinds: tuple[str, ...] = (".csv", ".json")) -> list[str]:
    """The addresses of all data files below a folder, sorted; names that begin with '.' or '~' are skipped."""
    return sorted(f for f in _files(spark, folder, True) if f.endswith(kinds) and f.rsplit("/", 1)[1][0] not in ".~")


def data_rows(spark: SparkSession, path: str) -> int:
    """The rows of a CSV file with a header; 0 where there is no file, or nothing in it."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return 0
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).count()


def tolerant(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The sources that can be read, and why the others can't. Schemas are resolved, no data is read."""
    found, missing = {}, {}
    for name, read in readers.items():
        try:
            df = read()
            df.schema  # noqa: B018
            found[name] = df
        except Exception as e:
            missing[name] = str(e).splitlines()[0]
    return found, missing


def text_and_label(columns: list[str]) -> tuple[str | None, str | None]:
    """The columns that hold text and label, by name."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[n] for n in TEXT_NAMES if n in low), None), next((low[n] for n in LABEL_NAMES if n in low), None)


def newest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The last name, in order of names, of a folder's files that matches."""
    return max((n for n in (f.rsplit("/", 1)[1] for f in _files(spark, folder, False)) if re.fullmatch(pattern, n)), default=None)


def blocks(text: str, aliases: dict[str, str] | None = None) -> list[dict[str, str]]:
    """Blocks of key and value lines, parted by blank lines; a colon may be full-width. The first line of a block is its name."""
    out = []
    for block in re.split(r"\n\s*\n", text.strip()):
        rows = [x.strip() for x in block.splitlines() if x.strip()]
        if not rows:
            continue
        name = rows[0].rstrip(":：").strip()
        entry = {"name": (aliases or {}).get(name, name).strip().lower()}
        for row in rows[1:]:
            if m := re.match(r"([^:：]+)[:：]\s*(.*)", row):
                entry[m[1].strip().lower()] = m[2].strip()
        out.append(entry)
    return out


def generated(prompts: DataFrame, call: Callable[[str], str | None], column: str = "prompt") -> DataFrame:
    """Adds ``result`` of a pluggable generator, a batch at a time in the executors; null where it gives none or fails."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("result", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            for prompt in batch[column]:
                try:
                    results.append(call(prompt) if prompt is not None else None)
                except Exception:
                    results.append(None)
            yield batch.assign(result=results)

    return prompts.mapInPandas(run, schema)


def with_failover(calls: list[Callable[[str], str | None]], attempts: int = 3, pause: Callable[[int], None] | None = None) -> Callable[[str], str | None]:
    """A generator that tries several in turn, from a place that depends on the prompt, up to so many attempts; null if all fail.

    ``pause`` is called between attempts with their number.
    """
    import zlib

    def call(prompt: str) -> str | None:
        first = zlib.crc32(prompt.encode())
        for k in range(attempts):
            try:
                out = calls[(first + k) % len(calls)](prompt)
                if out:
                    return out
            except Exception:
                pass
            if pause:
                pause(k)
        return None

    return call


@dataclass
class Endpoint:
    """A service: its name, all its models, its models by family, and what calls it with prompt and model."""

    name: str
    models: list[str]
    call: Callable[[str, str], str | None]
    family_models: dict[str, list[str]] = field(default_factory=dict)


class Limited(Exception):
    """A call failed because the service is busy or its answer can't be read; the next attempt waits longer."""


def routed(endpoints: list[Endpoint], attempts: int = 3, pause: Callable[[float], None] | None = None, busy: float = 6.0, failed: float = 2.0) -> Callable[[str, str], tuple[str | None, str, str]]:
    """A generator that routes a prompt to the services that have models of its family, or to all if none has.

    The services are taken in an order that depends on prompt and family, up to ``attempts`` of them, each with one of its models of the
    family, or of all its models. Gives text, service and model; or null, 'all_failed' and the last failure as service and reason. Between attempts
    ``pause`` is called with seconds.
    """

    def call(prompt: str, family: str) -> tuple[str | None, str, str]:
        rng = random.Random(f"{family}|{prompt}")
        able = [e for e in endpoints if e.family_models.get(family)] or list(endpoints)
        rng.shuffle(able)
        last = "exhausted"
        for e in able[: max(0, attempts)]:
            model = rng.choice(e.family_models.get(family) or e.models)
            wait = failed
            try:
                out = e.call(prompt, model)
                if out:
                    return out, e.name, model
                last = f"{e.name}:empty"
            except Limited as x:
                last, wait = f"{e.name}:{x}", busy
            except Exception as x:
                last = f"{e.name}:{x}"
            if pause:
                pause(wait)
        return None, "all_failed", last

    return call
