"""A sliding-log rate limiter, for a table and for a stream.

Whether a request is admitted depends on the admissions before it, so it is no window function: each key's requests are
taken in order of time. Admitted requests are logged, rejected ones are not; entries older than the window go.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def admit(log: deque, now: float, limit: int, window: float) -> bool:
    """Evicts what is strictly older than the window, then admits if fewer than ``limit`` are left; a limit of 0 or less admits all."""
    if limit <= 0:
        return True
    while log and log[0] < now - window:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(now)
    return True


def limited(requests: DataFrame, limits: dict[str, int], window: float = 60.0, default: int = 0) -> DataFrame:
    """Adds ``admitted`` to requests (``id``, ``scope``, ``client``, ``ts`` in seconds).

    Rows are spread by key and sorted within partitions, and one pass keeps only the current key's log of at most ``limit`` entries: a key
    that holds a third of all requests needs time in one task, but no memory. Ties in time go by id; a null client is 'unknown'.
    """
    r = requests.select("id", "scope", F.coalesce("client", F.lit("unknown")).alias("client"), F.col("ts").cast("double").alias("ts"))
    placed = r.repartition("scope", "client").sortWithinPartitions("scope", "client", "ts", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, log = None, deque()
        for batch in batches:
            scopes, clients, times = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = []
            for s, c, t in zip(scopes, clients, times):
                if (s, c) != key:
                    key, log = (s, c), deque()
                out.append(admit(log, t, limits.get(s, default), window))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=["id", "scope", "client", "ts", "admitted"])

    kind = requests.schema["id"].dataType.simpleString()
    return placed.mapInArrow(run, f"id {kind}, scope string, client string, ts double, admitted boolean")


class Limiter(StatefulProcessor):
    """The same for a stream, keyed by scope and client: the log is a list state."""

    def __init__(self, limits: dict[str, int], window: float = 60.0, default: int = 0) -> None:
        self.limits, self.window, self.default = limits, window, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "ts double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        log = deque(x[0] for x in self.log.get())
        for batch in rows:
            ordered = batch.sort_values(["ts", "id"])
            ordered["admitted"] = [admit(log, t, self.limits.get(key[0], self.default), self.window) for t in ordered["ts"]]
            yield ordered[["id", "scope", "client", "ts", "admitted"]]
        self.log.put([(t,) for t in log])

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, limits: dict[str, int], window: float = 60.0) -> DataFrame:
    """``limited`` for a streaming ``requests`` (``id`` BIGINT, ``scope``, ``client``, ``ts`` DOUBLE). Needs the RocksDB state store."""
    return requests.groupBy("scope", "client").transformWithStateInPandas(Limiter(limits, window), "id bigint, scope string, client string, ts double, admitted boolean", outputMode="Append", timeMode="None")
