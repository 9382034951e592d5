"""Bucketed installs: the same result as the edge merge, without a shuffle of the state."""

from pyspark.sql import functions as F

from hostloom.operators import host_titles, merge

EDGE = "name string, host_id long, version string, source string, extension_key string, first_seen timestamp, last_seen timestamp"


def edge(spark, rows):
    stamped = [(n, h, v, s, k, "2001-01-01", "2001-01-01") for n, h, v, s, k in rows]
    raw = spark.createDataFrame(stamped, "name string, host_id long, version string, source string, extension_key string, a string, b string")
    return raw.select("name", "host_id", "version", "source", "extension_key", F.col("a").cast("timestamp").alias("first_seen"), F.col("b").cast("timestamp").alias("last_seen"))


def test_a_batch_meets_the_state_where_it_lies(spark):
    state = edge(spark, [(f"t{i % 5}", i, "1", "apps", None) for i in range(60)] + [("old name", 3, "1", "x", "ext:a"), ("gone", 4, "1", "x", "ext:b"), ("keeps", 5, "7", "apps", "ext:c")])
    batch = edge(spark, [("t3", 3, "2", None, None), ("new name", 3, "1", "x", "ext:a"), ("fresh", 4, "1", "apps", None), ("keeps", 5, None, None, None), ("born", 900, "1", "apps", None), ("dropped", 7, "1", "apps", None)])
    hosts = spark.createDataFrame([(3,), (4,), (5,), (6,), (900,)], "host_id long")
    host_titles.save_titles(host_titles.titles_by_host(state), "titles_test", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        after = host_titles.upsert_titles(spark.table("titles_test"), batch, hosts, "2002-01-01")
        got = sorted(map(repr, (tuple(r) for r in host_titles.edges_of(after).collect())))
        want = merge.upsert_installed_on(state, batch, hosts, "2002-01-01").select("name", "host_id", *host_titles.TITLE[1:])
        assert got == sorted(map(repr, (tuple(r) for r in want.collect())))
        assert not any(", 6," in r for r in got) and any("'fresh', 4" in r for r in got) and not any("dropped" in r for r in got)
        plan = after._jdf.queryExecution().executedPlan().toString()
        scan = next(k for k, line in enumerate(plan.splitlines()) if "titles_test" in line)
        side = plan.splitlines()[:scan]
        depth = plan.splitlines()[scan].find("Scan") if "Scan" in plan.splitlines()[scan] else plan.splitlines()[scan].find("FileScan")
        above = []
        for line in reversed(side):
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                above.append(line)
                depth = at
        assert above and not any("Exchange" in line for line in above[: next(k for k, line in enumerate(above) if "Join" in line)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE titles_test")
