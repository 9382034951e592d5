"""Streams with state: tables that move together, restarts, stale hosts; and the file readers."""

import json

import pytest
from pyspark.sql import functions as F

from hostloom.sources import readers
from hostloom.streaming import inventory_stream, inventory_tables, last_seen
from hostloom.streaming.state_tables import StateTables


def land(folder, name, docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")


def doc(i, day, software=(), users=None, **more):
    return {"id": i, "hostname": f"h{i}", "platform": "ubuntu", "updated_at": f"{day}T00:00:00Z", "software_updated_at": day, "software": [{"name": n, "version": v, "source": "apps"} for n, v in software], "users": users} | more


def shown(tables):
    out = {}
    for t, columns in (("hosts", ["host_id", "updated_at"]), ("uses", ["username", "host_id"]), ("users", ["username"]), ("software", ["name", "versions", "last_version"]), ("installed_on", ["name", "host_id", "version", "first_seen", "last_seen"])):
        out[t] = sorted(map(repr, (tuple(r) for r in tables[t].select(*columns).collect())))
    return out


def batch(spark, *docs):
    return readers.named_hosts(spark.read.schema(readers.HOST_DOCUMENT).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs])))


def test_a_batch_that_dies_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    step = inventory_tables.merge_documents(path, buckets=4)
    step(batch(spark, doc(1, "2001-01-01", [("Slack", "1.0"), ("Zoom", "2")], ["ann"]), doc(2, "2001-01-01", [("slack", "1.1")], ["bob"])), 0)
    before = shown(inventory_tables.inventory_tables(spark, path, 4))
    assert len(before["installed_on"]) == 3 and len(before["software"]) == 2
    second = batch(spark, doc(1, "2001-02-01", [("slack", "3.0")], ["cat"]), doc(3, "2001-02-01", [("git", "9")], ["ann"]))
    write, calls = StateTables.write, []

    def dies(self, name, *rest):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return write(self, name, *rest)

    monkeypatch.setattr(StateTables, "write", dies)
    with pytest.raises(RuntimeError):
        step(second, 1)
    monkeypatch.setattr(StateTables, "write", write)
    assert shown(inventory_tables.inventory_tables(spark, path, 4)) == before
    step(second, 1)
    after = shown(inventory_tables.inventory_tables(spark, path, 4))
    assert [r for r in after["installed_on"] if "'zoom'" in r] == [] and len(after["hosts"]) == 3
    assert any("'slack', ['1.0', '1.1', '3.0'], '3.0'" in r for r in after["software"])
    assert any("'slack', 1, '3.0', datetime.datetime(2001, 1, 1" in r for r in after["installed_on"])
    assert after["uses"] == ["('ann', 3)", "('bob', 2)", "('cat', 1)"]
    step(batch(spark, doc(9, "2001-03-01")), 1)  # a committed batch is skipped
    assert shown(inventory_tables.inventory_tables(spark, path, 4)) == after


def test_a_failed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    step = inventory_tables.merge_documents(path, buckets=2)
    step(batch(spark, doc(1, "2001-01-01", [("a", "1")])), 0)
    before = shown(inventory_tables.inventory_tables(spark, path, 2))
    monkeypatch.setattr(StateTables, "commit", lambda *a: (_ for _ in ()).throw(OSError("no rename")))
    with pytest.raises(OSError):
        step(batch(spark, doc(1, "2001-02-01", [("b", "1")])), 1)
    monkeypatch.undo()
    assert shown(inventory_tables.inventory_tables(spark, path, 2)) == before


def test_only_touched_buckets_and_two_versions_stay(spark, tmp_path):
    path = str(tmp_path / "state")
    step = inventory_tables.merge_documents(path, buckets=8)
    step(batch(spark, *[doc(i, "2001-01-01", [(f"t{i}", "1")]) for i in range(40)]), 0)
    for k in range(1, 4):
        step(batch(spark, doc(5, f"2001-01-0{k + 1}", [("t5", str(k))])), k)
    tables = inventory_tables.state_tables(spark, path, 8)
    assert tables.committed() == [2, 3]
    held = tables.manifest(3)
    assert sorted(held["hosts"].values()) == [0] * 7 + [3]
    versions = {p.parent.name for p in (tmp_path / "state" / "hosts").glob("v=*/bucket=*")}
    assert versions == {"v=0", "v=2", "v=3"}
    assert tables.current()["installed_on"].count() == 40


def test_older_documents_lose_and_empty_lists_clear(spark, tmp_path):
    path = str(tmp_path / "state")
    step = inventory_tables.merge_documents(path, buckets=2)
    step(batch(spark, doc(1, "2001-05-01", [("a", "2")], ["ann"]), doc(2, "2001-05-01", [("b", "1")])), 0)
    step(batch(spark, doc(1, "2001-04-01", [("old", "1")], ["old"]), doc(2, "2001-06-01", []), doc(2, "2001-05-20", [("late", "1")])), 1)
    out = shown(inventory_tables.inventory_tables(spark, path, 2))
    assert [r[:9] for r in out["installed_on"]] == ["('a', 1, "] and out["uses"] == ["('ann', 1)"]
    assert not any("old" in r or "late" in r for rows in out.values() for r in rows)
    step(batch(spark, doc(3, "2001-07-01", [], None, updated_at=None, software_updated_at=None)), 2)
    assert inventory_tables.inventory_tables(spark, path, 2)["hosts"].count() == 3
    assert shown(inventory_tables.inventory_tables(spark, str(tmp_path / "none"), 2))["hosts"] == []


def test_the_stream_restarts_and_reads_bad_lines_past(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing, "a.json", [doc(1, "2001-01-01", [("a", "1")], ["ann"]), '{"id": 2, "host', doc(3, "2001-01-01", [("b", "1")])])
    run = lambda: inventory_tables.stream_inventory(readers.stream_host_documents(spark, str(landing)), str(tmp_path / "state"), str(tmp_path / "check"), buckets=2).awaitTermination()
    run()
    land(landing, "b.json", [doc(1, "2001-02-01", [("a", "2")], ["bob"])])
    run()
    run()
    out = shown(inventory_tables.inventory_tables(spark, str(tmp_path / "state"), 2))
    assert len(out["hosts"]) == 2 and out["uses"] == ["('bob', 1)"] and any("'a', ['1', '2'], '2'" in r for r in out["software"])


def test_hosts_go_stale_and_come_back(spark, tmp_path):
    schema = "host_id long, hostname string, platform string, updated_at timestamp"
    landing = str(tmp_path / "in")

    def run(rows):
        spark.createDataFrame(rows, "host_id long, hostname string, platform string, at string").withColumn("updated_at", F.col("at").cast("timestamp")).drop("at").coalesce(1).write.mode("append").parquet(landing)
        docs = spark.readStream.schema(schema).parquet(landing)
        last_seen.stream_host_last_seen(docs, str(tmp_path / "state"), str(tmp_path / "check"), buckets=2).awaitTermination()
        state = inventory_stream.host_state(spark, str(tmp_path / "state"), last_seen.COLUMNS)
        return {r.host_id: (r.hostname, str(r.updated_at), r.stale) for r in state.collect()}

    first = run([(1, "a", "x", "2001-01-01"), (1, "b", "x", "2001-01-02"), (2, "c", None, "2001-01-05"), (None, "n", "x", "2001-01-05"), (3, "d", "x", None)])
    assert first == {1: ("b", "2001-01-02 00:00:00", False), 2: ("c", "2001-01-05 00:00:00", False)}
    second = run([(2, "c", "x", "2001-01-10"), (4, "e", "x", "2001-01-09")])
    assert second[1] == ("b", "2001-01-02 00:00:00", True) and second[2] == ("c", "2001-01-10 00:00:00", False)
    third = run([(1, "back", "x", "2001-01-20"), (4, "late", "x", "2001-01-01")])
    assert third == {1: ("back", "2001-01-20 00:00:00", False), 2: ("c", "2001-01-10 00:00:00", True), 4: ("e", "2001-01-09 00:00:00", True)}


def test_quarantine_covers_every_line_that_is_not_read(spark, tmp_path):
    land(tmp_path / "in", "x.json", [doc(1, "2001-01-01"), '{"id": 2, "hostname": "cut', '{"hostname": "none"}', '{"id": "three"}', "[1]", "", '{"id": 4, "other": 1}'])
    path = str(tmp_path / "in")
    assert sorted(r.id for r in readers.read_host_documents(spark, path).select("id").collect()) == [1, 4]
    bad = [(r.cause, r.record) for r in readers.quarantine(spark, path).orderBy("cause", "record").collect()]
    assert [c for c, _ in bad] == ["malformed", "malformed", "malformed", "no id"] or [c for c, _ in bad] == ["malformed", "malformed", "no id", "no id"]
    assert any(r == '{"id": 2, "hostname": "cut' for _, r in bad) and all(r.file.endswith("x.json") for r in readers.quarantine(spark, path).collect())


def test_readers_of_users_labels_and_blocklists(spark, tmp_path):
    land(tmp_path / "users", "u.json", [{"username": "ann", "email": " a@x ", "full_name": "Ann A"}, {"email": "b@x"}, {"name": "carl", "username": " "}, {"full_name": "nobody"}])
    assert sorted(tuple(r) for r in readers.read_users(spark, str(tmp_path / "users")).fillna("-").collect()) == [("ann", "a@x", "Ann A"), ("b@x", "b@x", "-"), ("carl", "-", "carl")]
    land(tmp_path / "labels", "l.json", [{"id": 1, "name": "All Hosts"}, {"id": 2, "name": "mine", "label_type": "Builtin"}, {"id": 3, "name": "x", "label_membership_type": " MANUAL "}, {"name": "no id"}])
    assert sorted((r.label_id, r.label_type, r.membership_type) for r in readers.read_labels(spark, str(tmp_path / "labels")).collect()) == [(2, "builtin", "dynamic"), (3, "regular", "manual")]
    assert [r.label_id for r in readers.read_labels(spark, str(tmp_path / "labels"), True).orderBy("label_id").collect()] == [1, 3]
    land(tmp_path / "block", "b.json", [{"guid": "g1", "why": "b", "versionRange": [{"minVersion": "1", "maxVersion": "2"}]}, {"guid": "g1", "why": "a", "versionRange": [{"minVersion": "5", "maxVersion": "*"}]}, {"guid": "g2"}, {"why": "no guid"}])
    got = {r.guid: (r.why, sorted(x.minVersion for x in r.ranges)) for r in readers.read_blocklist(spark, str(tmp_path / "block")).collect()}
    assert got == {"g1": ("a", ["1", "5"]), "g2": (None, [])}


def test_a_large_bucket_is_dealt_over_several_tasks(spark, tmp_path):
    tables = StateTables(spark, str(tmp_path / "state"), {"t": ("k bigint, v string", "k")}, 2)
    rows = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "200k")
    try:
        assert tables.write("t", rows, 0, [0, 1]) == {"0": 0, "1": 0}
    finally:
        spark.conf.unset(size)
    for bucket in (0, 1):
        assert len(list((tmp_path / "state" / "t" / "v=0" / f"bucket={bucket}").glob("*.parquet"))) > 1
    assert tables.read("t", {"t": {"0": 0, "1": 0}}).distinct().count() == 40_000


def test_a_table_without_rows_is_an_empty_plan(spark, tmp_path):
    tables = inventory_tables.state_tables(spark, str(tmp_path / "none"), 2)
    for name, df in tables.current().items():
        assert df.schema == spark.createDataFrame([], inventory_tables.TABLES[name][0]).schema
        assert "LocalRelation <empty>" in df._jdf.queryExecution().optimizedPlan().toString()
