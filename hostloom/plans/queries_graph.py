"""Queries over the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostloom.operators import graph

from hostloom.plans.inventory import SQL, inventory
from hostloom.plans.queries_core import flat

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LINKS = """, links AS (SELECT DISTINCT 'user_' || username AS src, 'host_' || host_id AS dst, 'USES' AS kind FROM uses SEMI JOIN hosts USING (host_id)
UNION SELECT DISTINCT 'software_' || name, 'host_' || host_id, 'INSTALLED_ON' FROM installed_on SEMI JOIN hosts USING (host_id)),
nodes AS (SELECT 'host_' || host_id AS id, 'host' AS kind, hostname AS label, team_name, CAST(NULL AS VARCHAR) AS category FROM hosts
UNION ALL SELECT 'user_' || username, 'user', username, NULL, NULL FROM users UNION ALL SELECT 'software_' || name, 'software', display_name, NULL, category[1] FROM software),
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM links UNION ALL SELECT dst FROM links) GROUP BY id)"""


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: flat(f(inventory(spark, sf_dir)))
        if sql:
            ORACLE_SQL[key] = SQL + sql
        return f

    return register


def _blast(seed_edges: str) -> str:
    return f""", se AS ({seed_edges}), reach AS (SELECT DISTINCT seed, host_id FROM se SEMI JOIN hosts USING (host_id)),
imp AS (SELECT DISTINCT seed, username FROM reach JOIN uses USING (host_id) WHERE username <> seed),
lat AS (SELECT DISTINCT seed, u.host_id FROM imp JOIN uses u USING (username) SEMI JOIN hosts h ON h.host_id = u.host_id),
m AS (SELECT seed, coalesce(r.hr, 0) AS host_reach, coalesce(r.p, 0) AS platforms, coalesce(r.t, 0) AS teams, coalesce(i.n, 0) AS user_impact, coalesce(l.n, 0) AS lateral
FROM (SELECT DISTINCT seed FROM seeds) LEFT JOIN (SELECT seed, count(*) AS hr, count(DISTINCT platform) AS p, count(DISTINCT team_id) AS t FROM reach JOIN hosts USING (host_id) GROUP BY seed) r USING (seed)
LEFT JOIN (SELECT seed, count(*) AS n FROM imp GROUP BY seed) i USING (seed) LEFT JOIN (SELECT seed, count(*) AS n FROM lat ANTI JOIN reach USING (seed, host_id) GROUP BY seed) l USING (seed))"""


@query(", seeds AS (SELECT name AS seed FROM software)" + _blast("SELECT name AS seed, host_id FROM installed_on") + " SELECT * FROM m")
def gr1_blast_software(inv):
    return graph.blast_radius(inv, "software", inv.software.select(F.col("name").alias("seed")))


@query(", seeds AS (SELECT username AS seed FROM users)" + _blast("SELECT username AS seed, host_id FROM uses") + """, t AS (SELECT (SELECT count(*) FROM hosts) AS h, (SELECT count(DISTINCT username) FROM uses SEMI JOIN hosts USING (host_id)) AS u)
SELECT m.*, least(CAST(floor(host_reach * 100 / h) AS INTEGER), 100) AS host_score, least(CAST(floor(user_impact * 100 / u) AS INTEGER), 100) AS user_score, least(CAST(floor(m."lateral" * 100 / h) AS INTEGER), 100) AS lateral_score, least(CAST(floor(platforms * 100 / 3) AS INTEGER), 100) AS platform_score FROM m, t""")
def gr2_blast_scores(inv):
    return graph.blast_scores(graph.blast_radius(inv, "user", inv.users.select(F.col("username").alias("seed"))), inv)


_STEPS = "".join(f""", p{i} AS (SELECT a, b, dst AS node, min({{'nodes': list_append(p.nodes, dst), 'kinds': list_append(p.kinds, kind)}}) AS p FROM p{i - 1} JOIN e ON src = node
  ANTI JOIN ({" UNION ALL ".join(f"SELECT a, b, node FROM p{k}" for k in range(i))}) s ON s.a = p{i - 1}.a AND s.b = p{i - 1}.b AND s.node = e.dst GROUP BY a, b, dst)""" for i in range(1, 5))


@query(LINKS + """, e AS (SELECT src, dst, min(kind) AS kind FROM (SELECT src, dst, kind FROM links UNION ALL SELECT dst, src, kind FROM links) GROUP BY src, dst),
ends AS (SELECT 'host_' || min(host_id) AS a, 'host_' || max(host_id) AS b FROM hosts GROUP BY team_id),
p0 AS (SELECT a, b, a AS node, {'nodes': [a], 'kinds': CAST([] AS VARCHAR[])} AS p FROM ends)""" + _STEPS + """
SELECT a, b, coalesce(array_to_string(p.nodes, '|'), '') AS nodes, coalesce(array_to_string(p.kinds, '|'), '') AS kinds
FROM ends LEFT JOIN (""" + " UNION ALL ".join(f"SELECT a, b, p FROM p{i} WHERE node = b" for i in range(5)) + """) USING (a, b)""")
def gr3_shortest_paths(inv):
    ends = inv.hosts.groupBy("team_id").agg(F.concat(F.lit("host_"), F.min("host_id")).alias("a"), F.concat(F.lit("host_"), F.max("host_id")).alias("b"))
    return graph.shortest_paths(ends, graph.links(inv), 4)


@query(LINKS + """, seeds AS (SELECT 'user_' || username AS seed FROM users), both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
h1 AS (SELECT seed, dst AS node FROM seeds JOIN both_ways ON src = seed), h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN both_ways ON src = node),
seen AS (SELECT seed, node, min(hop) AS hop FROM (SELECT seed, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) GROUP BY ALL)
SELECT seed, node, hop, total > 500 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS r, count(*) OVER (PARTITION BY seed) AS total FROM seen) WHERE r <= 500""")
def gr4_ego_networks(inv):
    return graph.ego_network(inv.users.select(F.concat(F.lit("user_"), "username").alias("seed")), graph.links(inv), 2)[0]


@query(LINKS + " SELECT * FROM nodes SEMI JOIN (SELECT src AS id FROM links WHERE kind = 'USES' UNION SELECT dst FROM links WHERE kind = 'USES') USING (id)")
def gr5_user_graph(inv):
    return graph.user_graph(inv)[0]


@query(LINKS + """, top AS (SELECT src FROM links WHERE kind = 'INSTALLED_ON' GROUP BY src ORDER BY count(DISTINCT dst) DESC, src LIMIT 50)
SELECT * FROM links WHERE kind = 'USES' OR src IN (SELECT src FROM top)""")
def gr6_full_graph(inv):
    return graph.full_graph(inv)[1]


@query(LINKS + """, r AS (SELECT nodes.*, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY kind ORDER BY coalesce(degree, 0) DESC, id) AS r FROM nodes LEFT JOIN deg USING (id))
SELECT id, kind, label, team_name, category, degree FROM r ORDER BY (r <= 200 // 3) DESC, degree DESC, id LIMIT 200""")
def gr7_sample_graph(inv):
    return graph.sample_graph(graph._named(inv), graph.links(inv), 200)[0]


@query(LINKS + """, k AS (SELECT id FROM nodes LEFT JOIN deg USING (id) ORDER BY coalesce(degree, 0) DESC, id LIMIT 150) SELECT src, dst, links.kind FROM links WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def gr8_cap_graph(inv):
    return graph.cap_graph(graph._named(inv), graph.links(inv), 150)[1]


@query(LINKS + ", hs AS (SELECT dst FROM links WHERE src = 'software_xmrig 3') SELECT * FROM links WHERE dst IN (SELECT dst FROM hs) AND (kind = 'USES' OR src = 'software_xmrig 3')", "gr9_software_graph")
def _software_graph(inv):
    return graph.software_graph(inv, "xmrig 3")[1]


@query(LINKS + ", one AS (SELECT host_id FROM hosts WHERE hostname = 'host-7' ORDER BY last_seen DESC NULLS LAST, host_id LIMIT 1) SELECT * FROM links WHERE dst = (SELECT 'host_' || host_id FROM one)", "gr9_host_graph")
def _host_graph(inv):
    return graph.host_graph(inv, "HOST-7")[1]


@query(" SELECT * FROM (SELECT 'USES' AS kind, username AS source, hostname FROM uses JOIN hosts USING (host_id) ORDER BY 2, 3 LIMIT 250) UNION ALL SELECT * FROM (SELECT 'INSTALLED_ON', name, hostname FROM installed_on JOIN hosts USING (host_id) ORDER BY 2, 3 LIMIT 250)")
def gr10_relationships(inv):
    return graph.relationships(inv)


@query(LINKS + " SELECT CASE kind WHEN 'host' THEN 'team:' || coalesce(team_name, 'none') WHEN 'software' THEN 'category:' || coalesce(category, 'none') ELSE 'users' END AS cluster, count(*) AS nodes FROM nodes GROUP BY 1")
def gr11_clusters(inv):
    return graph.cluster_keys(graph._named(inv))
