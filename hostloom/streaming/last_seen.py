"""The last record of each host as streaming state, with a timer that tells when a host has gone quiet."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hostloom.operators.merge import SKEW_MINUTES, STALE_DAYS
from hostloom.streaming.inventory_stream import merge_newest

COLUMNS = "host_id bigint, hostname string, platform string, updated_at timestamp, stale boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastSeen(StatefulProcessor):
    """Per host the newest record, and one event-time timer `days` after it. When the timer fires the host is stale: it is
    emitted once more and its state goes, so quiet hosts cost nothing; a later record starts it afresh."""

    def __init__(self, days: int = STALE_DAYS):
        self.millis = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hostname string, platform string, at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest = max(((int(a), h or "", p or "") for df in rows for a, h, p in zip(df["at"], df["hostname"], df["platform"], strict=True)), default=None)
        before = self.last.get() if self.last.exists() else None
        if newest is None or before is not None and (before[2], before[0], before[1]) >= newest:
            return
        at, hostname, platform = newest
        if before is not None:
            self.handle.deleteTimer(before[2] + self.millis)
        self.last.update((hostname, platform, at))
        self.handle.registerTimer(at + self.millis)
        yield self._row(key, (hostname, platform, at), False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        self.last.clear()
        yield self._row(key, last, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: Any, last: tuple, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"host_id": [key[0]], "hostname": [last[0]], "platform": [last[1]], "at": [last[2]], "stale": [stale]})


def host_last_seen(docs: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """A stream of (host_id, hostname, platform, updated_at, stale): each newer record of a host, and once more, as stale,
    when the watermark (greatest updated_at less the clock skew) has passed its last record by `days`.

    Rows without host_id or updated_at have no place in time and are left out; rows at or below the watermark are late and
    dropped. Of records at one time the greatest by hostname and platform counts."""
    rows = docs.where(F.col("host_id").isNotNull() & F.col("updated_at").isNotNull()).withWatermark("updated_at", f"{SKEW_MINUTES} minutes")
    rows = rows.select(F.col("host_id").cast("long").alias("host_id"), "hostname", "platform", "updated_at", F.unix_millis("updated_at").alias("at"))
    out = rows.groupBy("host_id").transformWithStateInPandas(statefulProcessor=LastSeen(days), outputStructType="host_id bigint, hostname string, platform string, at bigint, stale boolean", outputMode="Update", timeMode="EventTime")
    return out.select("host_id", "hostname", "platform", F.timestamp_millis("at").alias("updated_at"), "stale")


def stream_host_last_seen(docs: DataFrame, path: str, checkpoint: str, days: int = STALE_DAYS, buckets: int = 64) -> StreamingQuery:
    """Starts `host_last_seen` into bucketed state under `path` (read it by inventory_stream.host_state with COLUMNS);
    available input is processed, then the query ends. Its state store is RocksDB, on the executors' disks and in the checkpoint."""
    conf = docs.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)
    try:
        stream = host_last_seen(docs, days).writeStream.outputMode("update").foreachBatch(merge_newest(path, buckets))
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_PROVIDER, before)
