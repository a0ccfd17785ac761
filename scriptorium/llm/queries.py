"""The queries of the llm operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, cutoff, garble, mixing, nearness, overlap, packing, splitting


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    train, *evaluation = (_table(spark, sf_dir, name).select(F.col("row_id").alias("id"), "text", F.lit(name).alias("split"), "source") for name in ("train", "val", "test"))
    return train, evaluation[0].unionByName(evaluation[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.found(*_splits(spark, sf_dir))
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(*_splits(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.detect(_table(spark, sf_dir, "full_dataset_length_balanced"))[0].filter("cut").select("row_id")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.report(_table(spark, sf_dir, "full_dataset_length_balanced"))


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _table(spark, sf_dir, "full_dataset").select(F.col("row_id").alias("id"), "text")
    return full.unionByName(_table(spark, sf_dir, "parallel_dataset").select(F.col("row_id").alias("id"), F.col("text_content").alias("text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.found(_collection(spark, sf_dir)).select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.groups(_collection(spark, sf_dir)).withColumnRenamed("id", "row_id")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.linked(_collection(spark, sf_dir)).withColumnRenamed("id", "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(_table(spark, sf_dir, "full_dataset")).filter("piece = 0").select("row_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(_table(spark, sf_dir, "full_dataset"))


def p4_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.round_trip(p4_pieces(spark, sf_dir))


def p5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "full_dataset"), _table(spark, sf_dir, "source_weights"))[0]


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "full_dataset"), _table(spark, sf_dir, "source_weights"))[1]


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode(p6_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_hash"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))[1]


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.audit(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repair(_table(spark, sf_dir, "documents")).select("doc_id")


def p8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.repair(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_report, p3_found, p3_groups, p3_links, p4_found, p4_pieces, p4_round_trip, p5_mix, p5_shares, p6_ids, p6_round_trip, p7_containers, p7_fill, p7_audit, p8_found, p8_repair)}
