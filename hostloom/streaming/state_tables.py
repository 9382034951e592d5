"""State tables that change together: bucketed Parquet folders, of which a manifest names the versions that count."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StateTables:
    """Tables under one folder. A batch writes the buckets that it touches as `<table>/v=<batch>/bucket=<b>` and then
    commits: `manifests/<batch>.json` appears by one rename and names, for every table and bucket, the version that
    counts. Before that rename nothing that the batch wrote is read; after it, all of it is. A batch that is run again
    after a failure writes the same folders anew; one that has been committed is skipped.

    Tables are given as name -> (schema, key column); a row's bucket is a hash of its key. `buckets` is fixed for a folder:
    choose it so that few are touched by a batch.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str]], buckets: int):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def committed(self) -> list[int]:
        """The batches that have been committed, in order."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, batch_id: int | None) -> dict[str, dict[str, int]]:
        """table -> bucket -> version; none before the first batch."""
        if batch_id is None:
            return {t: {} for t in self.tables}
        file = self._fs.open(self._at(f"manifests/{batch_id}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def bucket(self, name: str) -> F.Column:
        return F.pmod(F.xxhash64(self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that the rows' keys fall into: at most `buckets` numbers."""
        return sorted(r.b for r in rows.select(self.bucket(name).alias("b")).distinct().collect())

    def read(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """The table as of a manifest, or some of its buckets."""
        schema = self.tables[name][0]
        held = manifest[name]
        chosen = held if buckets is None else {b: held[str(b)] for b in map(str, buckets) if b in held}
        folders = [f"{self.path}/{name}/v={v}/bucket={b}" for b, v in sorted(chosen.items(), key=lambda e: int(e[0]))]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self._none(name)

    def _none(self, name: str) -> DataFrame:
        """The table without rows, as a plan that the optimizer knows to be empty: joins with it cost nothing."""
        return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.tables[name][0])])

    def current(self) -> dict[str, DataFrame]:
        """All tables as of the last commit."""
        done = self.committed()
        manifest = self.manifest(done[-1] if done else None)
        return {t: self.read(t, manifest) for t in self.tables}

    def write(self, name: str, rows: DataFrame, batch_id: int, touched: list[int]) -> dict[str, int | None]:
        """Write the touched buckets whole; gives bucket -> version, None for a bucket that has become empty. A large bucket is
        dealt over several tasks and files."""
        at = f"{name}/v={batch_id}"
        columns = [f.name for f in StructType.fromDDL(self.tables[name][0])]
        rows.select(*columns, self.bucket(name).alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{at}")
        found = {n[7:] for n in self._names(at) if n.startswith("bucket=")}
        return {str(b): batch_id if str(b) in found else None for b in touched}

    def commit(self, batch_id: int, base: dict, written: dict[str, dict[str, int | None]]) -> None:
        """Make the written versions count, then remove versions that neither this manifest nor the one before names."""
        after = {t: {b: v for b, v in (base[t] | written.get(t, {})).items() if v is not None} for t in self.tables}
        draft, final = self._at(f"manifests/_{batch_id}.json"), self._at(f"manifests/{batch_id}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(after, sort_keys=True).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"batch {batch_id} could not be committed")
        done = self.committed()
        for old in done[:-2]:
            gone = self.manifest(old)
            kept = [self.manifest(b) for b in done[-2:]]
            for t, held in gone.items():
                for b, v in held.items():
                    if all(k[t].get(b) != v for k in kept):
                        self._fs.delete(self._at(f"{t}/v={v}/bucket={b}"), True)
            self._fs.delete(self._at(f"manifests/{old}.json"), True)
