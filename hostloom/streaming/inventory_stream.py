"""Structured Streaming: continuous ingest of host documents into stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostloom.operators.merge import SKEW_MINUTES

HOST_COLUMNS = "host_id bigint, hostname string, platform string, updated_at timestamp"


def stream_dedupe(docs: DataFrame) -> DataFrame:
    """A document that is fetched again within the clock skew is processed once: duplicates of (host_id, updated_at)
    within the watermark are dropped, later rows at or below it are late."""
    return docs.withWatermark("updated_at", f"{SKEW_MINUTES} minutes").dropDuplicatesWithinWatermark(["host_id", "updated_at"])


def newest(rows: DataFrame) -> DataFrame:
    """One row per host: the greatest updated_at, then the greatest in column order."""
    rest = [c for c in rows.columns if c not in ("host_id", "updated_at")]
    return rows.groupBy("host_id").agg(F.max(F.struct("updated_at", *rest)).alias("m")).select("host_id", *[F.col(f"m.{c}").alias(c) for c in rows.columns if c != "host_id"])


def _bucket_folders(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Of each bucket the versions that hold it, oldest first; versions that weren't finished don't count."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for v in fs.listStatus(root) if fs.exists(root) else []:
        if v.getPath().getName().startswith("v=") and fs.exists(jvm.Path(v.getPath(), "_SUCCESS")):
            for b in fs.listStatus(v.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    found.setdefault(int(b.getPath().getName()[7:]), []).append(int(v.getPath().getName()[2:]))
    return {b: sorted(vs) for b, vs in found.items()}


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def merge_newest(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: the state under `path` becomes the newest row of each host.

    State lies in buckets by a hash of the host. A batch reads and writes only the buckets that its hosts fall into, as
    `v=<batch>/bucket=<b>`; of each bucket the newest version counts. Choose `buckets` (fixed for a path) so that one fits a
    task. A batch that fails or runs again changes nothing that others have read: it starts from versions before its own, and
    each bucket's version before the last one is kept. Older ones are removed.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = F.pmod(F.xxhash64("host_id"), F.lit(buckets)).cast("int")
        batch = newest(batch).persist()
        touched = sorted(r.b for r in batch.select(number.alias("b")).distinct().collect())  # at most `buckets` numbers
        held = {b: [v for v in vs if v < batch_id] for b, vs in _bucket_folders(spark, path).items()}
        old = [f"{path}/v={held[b][-1]}/bucket={b}" for b in touched if held.get(b)]
        rows = newest(batch.unionByName(spark.read.schema(batch.schema).parquet(*old))) if old else batch
        rows.withColumn("bucket", number).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
        for b in touched:
            for v in held.get(b, [])[:-1]:
                _remove(spark, f"{path}/v={v}/bucket={b}")
        batch.unpersist()

    return step


def stream_host_state(docs: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Starts the ingest of a stream of host rows; available input is processed, then the query ends. A failed batch doesn't
    advance the checkpoint. The merge takes repeated and late rows as they come, so none is dropped."""
    return docs.writeStream.foreachBatch(merge_newest(path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def host_state(spark: SparkSession, path: str, schema: str = HOST_COLUMNS) -> DataFrame:
    """The state: the last version of each bucket; empty before the first batch."""
    last = [f"{path}/v={vs[-1]}/bucket={b}" for b, vs in sorted(_bucket_folders(spark, path).items())]
    return spark.read.schema(schema).parquet(*last) if last else spark.createDataFrame([], schema)


def stale_hosts(state: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Hosts not heard of for `days`."""
    return state.where(F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def stream_activity(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """(start, event_type, n): counts per event-time window, late rows beyond the clock skew dropped."""
    return events.withWatermark("ts", f"{SKEW_MINUTES} minutes").groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
