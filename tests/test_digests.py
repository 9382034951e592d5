"""Snapshots with digests: a diff reads the buckets that changed, and no others."""

from pyspark.sql import functions as F

from hostloom.operators import snapshot
from hostloom.plans.inventory import Inventory


def inventory_of(spark, platform="ubuntu", drop=()):
    hosts = spark.range(400).select(F.col("id").alias("host_id"), F.concat(F.lit("h"), "id").alias("hostname"), F.when(F.col("id") == 7, platform).otherwise("ubuntu").alias("platform"))
    users = spark.createDataFrame([(f"u{i}", None) for i in range(50)], "username string, email string")
    software = spark.createDataFrame([(f"s{i}", ["1"]) for i in range(30)], "name string, versions array<string>")
    labels = spark.createDataFrame([(1, "x")], "label_id long, name string")
    uses = spark.range(400).select(F.concat(F.lit("u"), F.col("id") % 50).alias("username"), F.col("id").alias("host_id"))
    installed = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 30).alias("name"), (F.col("id") % 400).alias("host_id")).distinct().where(~F.concat_ws("@", "name", "host_id").isin(*drop, ""))
    return Inventory(hosts, users, software, labels, uses, installed, spark.range(400).select(F.lit(1).cast("long").alias("label_id"), F.col("id").alias("host_id")))


def test_one_change_reads_one_bucket_of_each_kind(spark, tmp_path):
    path = str(tmp_path)
    for ts, inv in (("a", inventory_of(spark)), ("b", inventory_of(spark, "fedora", ["s7@7"])), ("c", inventory_of(spark))):
        snapshot.write_snapshot(inv, ts, path, 8)
    changed = sorted((r.part, r.kind) for r in snapshot.changed_buckets(spark, path, "a", "b").collect())
    assert changed == [("edges", "INSTALLED_ON"), ("nodes", "host")]
    rows = snapshot.changed_rows(spark, path, "a", "b")
    assert rows["nodes"][0].count() < 120 and len(rows["nodes"][0].inputFiles()) >= 1
    assert [tuple(r) for r in snapshot.diff_properties(*rows["nodes"]).collect()] == [("host", "host_7", "platform", "ubuntu", "fedora")]
    assert [tuple(r) for r in snapshot.diff_edges(*rows["edges"]).collect()] == [("removed", "INSTALLED_ON", "software_s7", "host_7")]
    assert snapshot.diff_nodes(*rows["nodes"]).count() == 0
    whole = [snapshot.read_snapshot(spark, path, ts) for ts in ("a", "b")]
    assert snapshot.diff_edges(whole[0][1], whole[1][1]).collect() == snapshot.diff_edges(*rows["edges"]).collect()
    assert snapshot.changed_buckets(spark, path, "a", "c").count() == 0
    same = snapshot.changed_rows(spark, path, "a", "c")
    assert all(df.count() == 0 for pair in same.values() for df in pair)
    snapshot.write_snapshot(inventory_of(spark, "fedora"), "c", path, 8)
    assert [(r.part, r.kind) for r in snapshot.changed_buckets(spark, path, "a", "c").collect()] == [("nodes", "host")]


def test_a_large_bucket_is_dealt_over_several_tasks_with_the_same_hashes(spark, tmp_path):
    inv, path, size = inventory_of(spark), str(tmp_path), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    many = spark.range(0, 40_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("username"), F.lit("x").alias("email"))
    inv = Inventory(inv.hosts, many, inv.software, inv.labels, inv.uses, inv.installed_on, inv.has_label)
    spark.conf.set(size, "200k")
    try:
        snapshot.write_snapshot(inv, "a", path, 2)
    finally:
        spark.conf.unset(size)
    for bucket in (0, 1):
        assert len(list((tmp_path / "nodes" / "snapshot_ts=a" / "kind=user" / f"bucket={bucket}").glob("*.parquet"))) > 1
    written, made = snapshot.read_snapshot(spark, path, "a")[0], snapshot.snapshot_nodes(inv, "a")
    assert written.join(made.select("kind", "id", "hash"), ["kind", "id", "hash"]).count() == made.count() == written.count()
