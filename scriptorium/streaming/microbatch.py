"""Micro-batch append that can be resumed and repeated without duplicates."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_once(batch: DataFrame, epoch: int, path: str, key: str, known: bool = False) -> None:
    """Writes a batch under its epoch, without keys that other epochs hold.

    The epoch's folder is overwritten, so a batch that is repeated after a crash leaves one copy. Of the sink only the files are read whose
    keys may lie between the batch's least and greatest; with ``known``, where the stream's own state has left out what was written before, none.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    if not known and _exists(spark, path):
        low, high = batch.agg(F.min(key), F.max(key)).first()
        done = spark.read.parquet(path).filter((F.col("epoch") != epoch) & F.col(key).between(low, high)).select(key)
        new = new.join(done, key, "left_anti")
    new.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def start(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends everything that is available now and ends.

    The keys written so far are kept in the stream's state, which the checkpoint holds, so no batch reads the sink. A sink that another
    checkpoint has written to is read by the range of each batch's keys.
    """
    spark = stream.sparkSession
    alone = _exists(spark, checkpoint) or not _exists(spark, path)
    return stream.dropDuplicates([key]).writeStream.foreachBatch(lambda b, e: append_once(b, e, path, key, alone)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until(batch: Callable[[], object], done: Callable[[], int], target: int, pause: Callable[[], None] | None = None, most: int | None = None) -> int:
    """Runs batches until ``done`` counts the target, or ``most`` batches; gives how many were run. A batch that fails is followed by the next.

    ``pause`` is called after each batch. Without ``most`` there is no end but the target.
    """
    n = 0
    while done() < target and (most is None or n < most):
        try:
            batch()
        except Exception as e:
            warnings.warn(f"batch {n} failed: {e}", stacklevel=2)
        n += 1
        if pause:
            pause()
    return n


def unfinished(plan: DataFrame, path: str, key: str) -> DataFrame:
    """Plan rows that the sink doesn't hold; failures come again, having no row there."""
    spark = plan.sparkSession
    return plan.join(spark.read.parquet(path).select(key), key, "left_anti") if _exists(spark, path) else plan


def progress(rows: DataFrame, target: int, minutes: float) -> DataFrame:
    """Done, failed, rate a minute and what is left."""
    done = F.count_if("success")
    return rows.agg(done.alias("done"), F.count_if(~F.col("success")).alias("failed")).select("done", "failed", F.round(F.col("done") / minutes, 6).alias("per_minute"), F.greatest(F.lit(target) - F.col("done"), F.lit(0)).alias("left"))


class Monitor(StreamingQueryListener):
    """Counts the rows of a session's streams and tells when a target is reached; add it with ``spark.streams.addListener``."""

    def __init__(self, target: int) -> None:
        self.target, self.rows, self.ended = target, 0, False

    @property
    def done(self) -> bool:
        return self.rows >= self.target

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = True
