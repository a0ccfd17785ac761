"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of the engine relies on. Sizes are left to the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "scriptorium", **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` (dots written as ``__``) wins over them."""
    builder = SparkSession.builder.appName(app)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what ``spark.checkpoint.dir`` names. Only a local master, as in tests, may leave that unset and gets a temporary folder
    of this machine; on a cluster executors would write and read different disks, so a missing setting is an error there.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"scriptorium-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", "file://" + own)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


#: Folders of staged tables that are still there, by application.
_staged: dict[str, dict[str, None]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """The address of a new folder below the shared one; it is removed by ``clear`` or when the interpreter ends."""
    path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex[:12]}"
    held = _staged.get(spark.sparkContext.applicationId)
    if held is None:
        held = _staged[spark.sparkContext.applicationId] = {}
        atexit.register(clear, spark)
    held[path] = None
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Cuts the lineage: what is read afterwards doesn't depend on any executor. The table is
    removed by ``release`` when nothing reads it any more, by ``clear``, or when the interpreter ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove staged tables, or unions of such, that no later action reads."""
    for df in tables:
        held = _staged.get(df.sparkSession.sparkContext.applicationId, {})
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            for known in [k for k in held if k.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")]:
                _remove(df.sparkSession, known)
                del held[known]


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application staged. Results that still read them can't be computed afterwards."""
    try:
        held = _staged.pop(spark.sparkContext.applicationId, {})
    except Exception:  # the session may already be gone
        return
    for path in held:
        _remove(spark, path)
