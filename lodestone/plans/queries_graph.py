"""Queries of graph operators (G)."""

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import migration as I
from lodestone.operators import relations as R
from lodestone.plans.queries_aggregates import HEALTH
from lodestone.registry import query

ASIA = 20  # node of the third region


def _seed(t, node_id):
    return t.spark.createDataFrame([(node_id, node_id)], "origin long, node_id long")


@query("SELECT edge_id, src, dst FROM {edges} WHERE src <> dst")
def g01_adjacency(t):
    return G.simple_edges(t.edges).select("edge_id", "src", "dst")


@query("WITH RECURSIVE walk AS (SELECT CAST(9 AS BIGINT) AS node, '9' AS path, 0 AS length UNION ALL SELECT e.dst, w.path || '>' || CAST(e.dst AS STRING), w.length + 1 FROM walk w JOIN {edges} e ON e.src = w.node WHERE w.length < 10) SELECT path, CAST(length AS BIGINT) AS length FROM walk w WHERE node IN (SELECT CAST(n_regionkey AS BIGINT) * 8 + 4 FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey WHERE o_orderkey = 1)")
def g02_find_paths(t):
    to = t.orders.where("o_orderkey = 1").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    found = G.find_paths(t.edges.select("src", "dst"), 9, to * 8 + 4)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length")


INBOUND = "WITH RECURSIVE r AS (SELECT CAST(20 AS BIGINT) AS node_id, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN {edges} e ON e.dst = r.node_id WHERE e.src <> e.dst) SELECT node_id, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node_id"


@query(INBOUND)
def g03_reachability_inbound(t):
    return G.reach(t.edges.select("src", "dst"), _seed(t, ASIA), outbound=False).select("node_id", "depth")


@query("WITH RECURSIVE r AS (SELECT o_orderkey * 8 + 1 AS node_id FROM {orders} WHERE o_orderkey = 1 UNION SELECT e.dst FROM r JOIN {edges} e ON e.src = r.node_id) SELECT count(*) - 1 AS reached, (count(*) - 1) / CAST((SELECT count(*) - 1 FROM {nodes}) AS DOUBLE) AS score FROM r")
def g03_reachability_score(t):
    total = t.nodes.agg((F.count("*") - 1).alias("n"))
    got = G.reach(t.edges.select("src", "dst"), _seed(t, 9), outbound=True).agg((F.count("*") - 1).alias("reached"))
    return got.join(total).select("reached", (F.col("reached") / F.col("n")).alias("score"))  # one row each


@query("SELECT edge_id FROM {edges} WHERE src IN (SELECT node_id FROM {nodes} WHERE node_type IN ('route', 'type')) OR dst IN (SELECT node_id FROM {nodes} WHERE node_type IN ('route', 'type'))")
def g04_subgraph_touching(t):
    ids = t.nodes.where(F.col("node_type").isin("route", "type"))
    return R.induced(t.edges, ids, both=False).select("edge_id")


@query("WITH RECURSIVE r AS (SELECT CAST(20 AS BIGINT) AS node_id, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN {edges} e ON e.dst = r.node_id) SELECT (SELECT count(*) FROM {edges} WHERE dst = 20) AS direct, count(*) AS cascading, 'high' AS severity FROM (SELECT node_id, min(depth) AS d FROM r GROUP BY node_id) WHERE d > 1")
def g05_impact_chain(t):
    return G.impact_chain(t.edges.select("src", "dst"), ASIA, t.nodes.count()).select("direct", "cascading", "severity")


@query("SELECT node_id FROM {nodes} WHERE node_id NOT IN (SELECT src FROM {edges}) AND node_id NOT IN (SELECT dst FROM {edges})")
def g06_orphans(t):
    return G.orphans(t.nodes, t.edges).select("node_id")


FLOWS = "SELECT CASE WHEN starts_with(a.path, 'g/nation/') AND starts_with(b.path, 'g/nation/') THEN 'INTERNAL' WHEN starts_with(a.path, 'g/nation/') THEN 'OUT' ELSE 'IN' END AS flow, e.* FROM {edges} e JOIN {nodes} a ON a.node_id = e.src JOIN {nodes} b ON b.node_id = e.dst WHERE starts_with(a.path, 'g/nation/') OR starts_with(b.path, 'g/nation/')"


@query(f"SELECT flow, count(*) AS n FROM ({FLOWS}) GROUP BY flow")
def g07_directory_subgraph(t):
    return R.boundary(t.edges, t.nodes, F.col("path").startswith("g/nation/")).groupBy("flow").agg(F.count("*").alias("n"))


@query(f"SELECT flow, edge_id FROM ({FLOWS}) WHERE flow <> 'INTERNAL'")
def g08_directory_boundary(t):
    return R.boundary(t.edges, t.nodes, F.col("path").startswith("g/nation/")).where("flow <> 'INTERNAL'").select("flow", "edge_id")


@query(f"SELECT flow, count(*) AS edges, count(DISTINCT CASE WHEN flow = 'IN' THEN src ELSE dst END) AS others, count(CASE WHEN status = 'MISSING' THEN 1 END) AS errors FROM ({FLOWS}) GROUP BY flow")
def g09_boundary_metrics(t):
    b = R.boundary(t.edges, t.nodes, F.col("path").startswith("g/nation/"))
    other = F.when(F.col("flow") == "IN", F.col("src")).otherwise(F.col("dst"))
    return b.groupBy("flow").agg(F.count("*").alias("edges"), F.count_distinct(other).alias("others"), F.count_if(F.col("status") == "MISSING").alias("errors"))


CLOSURE = "WITH RECURSIVE c AS (SELECT DISTINCT src AS a, dst AS b FROM {edges} WHERE src <> dst UNION SELECT c.a, e.dst FROM c JOIN {edges} e ON e.src = c.b)"


@query(CLOSURE + " SELECT n.node_id, count(c.a) AS impact FROM {nodes} n LEFT JOIN c ON c.b = n.node_id AND c.a <> n.node_id GROUP BY n.node_id")
def g11_impact_radius(t):
    return G.impact(t.edges.select("src", "dst"), t.nodes)


RING = "WITH RECURSIVE c AS (SELECT src AS a, dst AS b FROM {ring} WHERE src <> dst UNION SELECT c.a, e.dst FROM c JOIN {ring} e ON e.src = c.b), s AS (SELECT x.a AS node_id, least(x.a, min(x.b)) AS scc FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"


@query(f"""SELECT n.node_id, coalesce(i.impact, 0) AS exact, CASE WHEN coalesce(i.impact, 0) <= 512 THEN coalesce(i.impact, 0) END AS small, true AS close FROM {{nodes}} n LEFT JOIN
 (SELECT node_id, count(*) AS impact FROM (SELECT DISTINCT o.node AS node_id, o.origin FROM (WITH RECURSIVE r AS (SELECT node_id AS origin, node_id AS node FROM {{nodes}} UNION SELECT r.origin, e.dst FROM r JOIN {{edges}} e ON e.src = r.node AND e.src <> e.dst) SELECT * FROM r) o WHERE o.node <> o.origin) GROUP BY node_id) i ON i.node_id = n.node_id""")
def g11_impact_estimate(t):
    exact = G.impact(t.edges, t.nodes).withColumnRenamed("impact", "exact")
    both = exact.join(G.impact_estimate(t.edges, t.nodes), "node_id")
    near = F.abs(F.col("impact") - F.col("exact")) <= 0.2 * F.col("exact")
    return both.select("node_id", "exact", F.when(F.col("exact") <= 512, F.col("impact")).alias("small"), near.alias("close"))


@query(RING + " SELECT node_id, scc, count(*) OVER (PARTITION BY scc) AS size FROM s")
def g12_strong_components(t):
    return G.strong_components(t.ring)


@query(RING + " SELECT coalesce(a.scc, e.src) AS from_scc, coalesce(b.scc, e.dst) AS to_scc, count(*) AS edges FROM {ring} e LEFT JOIN s a ON a.node_id = e.src LEFT JOIN s b ON b.node_id = e.dst WHERE e.src <> e.dst AND coalesce(a.scc, e.src) <> coalesce(b.scc, e.dst) GROUP BY 1, 2")
def g12_condensation(t):
    return G.condensation(t.ring, G.strong_components(t.ring))


@query(RING + " SELECT scc, count(*) AS size, CASE WHEN count(*) > 20 THEN 'split' WHEN count(*) > 3 THEN 'extract' ELSE 'invert' END AS advice FROM s GROUP BY scc")
def g13_break_recommendations(t):
    sizes = G.strong_components(t.ring).groupBy("scc").agg(F.count("*").alias("size"))
    return sizes.withColumn("advice", F.when(F.col("size") > 20, "split").when(F.col("size") > 3, "extract").otherwise("invert"))


@query(RING + " SELECT 'cycle' AS conflict, scc, string_agg(CAST(node_id AS STRING), ',' ORDER BY node_id) AS members FROM s GROUP BY scc")
def g14_cycle_conflicts(t):
    members = G.strong_components(t.ring).groupBy("scc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), ",").alias("members"))
    return members.select(F.lit("cycle").alias("conflict"), "scc", "members")


PERSISTED = "WITH RECURSIVE e AS (SELECT DISTINCT source_id AS src, target_id AS dst FROM {connections} WHERE resolved AND source <> target), c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b) SELECT x.a AS node_id, least(x.a, min(x.b)) AS scc FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a"


@query(PERSISTED)
def g15_persisted_cycles(t):
    e = t.connections.where("resolved and source <> target").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return G.strong_components(e).select("node_id", "scc")


@query(f"SELECT node_id, indegree, outdegree, CASE WHEN indegree + outdegree = 0 THEN 'unused' WHEN node_type <> 'file' AND indegree = 0 THEN 'partial' ELSE 'healthy' END AS health FROM ({HEALTH})")
def g16_graph_health(t):
    return G.health(t.nodes, t.edges).select("node_id", "indegree", "outdegree", "health")


@query("SELECT r.doc_id FROM {registry} r WHERE r.doc_id NOT IN (SELECT source_id FROM {connections} WHERE resolved AND source <> target) AND r.doc_id NOT IN (SELECT target_id FROM {connections} WHERE resolved AND source <> target)")
def g18_orphaned_files(t):
    c = t.connections.where("resolved and source <> target")
    ends = c.select(F.col("source_id").alias("doc_id")).union(c.select("target_id")).distinct()
    return t.registry.join(ends, "doc_id", "left_anti").select("doc_id")


@query("WITH RECURSIVE r AS (SELECT CAST(11 AS BIGINT) AS node_id, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN {edges} e ON e.dst = r.node_id) SELECT CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'transitive' END AS kind, node_id FROM r WHERE depth > 0 GROUP BY node_id")
def g19_impact_analysis(t):
    got = G.reach(t.edges.select("src", "dst"), _seed(t, 11), outbound=False).where("depth > 0")
    return got.select(F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind"), "node_id")


LEVELS = CLOSURE + ", l AS (SELECT n.node_id, CASE n.node_type WHEN 'type' THEN 0 WHEN 'route' THEN 1 WHEN 'file' THEN 3 ELSE 2 END AS level FROM {nodes} n)"


@query("SELECT n.node_id, CAST(CASE n.node_type WHEN 'type' THEN 0 WHEN 'route' THEN 1 WHEN 'file' THEN 3 ELSE 2 END AS INT) AS level FROM {nodes} n")
def g25_parallel_levels(t):
    return G.levels(t.edges, t.nodes)


@query("SELECT node_type, CASE node_type WHEN 'type' THEN 1.5 WHEN 'route' THEN 4.0 WHEN 'file' THEN 7.0 ELSE 5.0 END::DOUBLE AS duration, count(*) AS n FROM {nodes} GROUP BY node_type")
def g24_critical_path(t):
    cost = F.when(F.col("node_type") == "type", 1.5).when(F.col("node_type") == "route", 2.5).when(F.col("node_type") == "file", 2.0).otherwise(1.0)
    d = G.critical_path(t.edges, t.nodes.select("node_id", cost.alias("cost")))
    return t.nodes.select("node_id", "node_type").join(d, "node_id").groupBy("node_type", "duration").agg(F.count("*").alias("n"))


@query("SELECT e.src, e.dst, least(a.n, b.n) AS cost FROM (SELECT DISTINCT src, dst FROM {ring} WHERE src <> dst) e JOIN (SELECT dst AS node_id, count(*) AS n FROM {ring} WHERE src <> dst GROUP BY dst) a ON a.node_id = e.src JOIN (SELECT dst AS node_id, count(*) AS n FROM {ring} WHERE src <> dst GROUP BY dst) b ON b.node_id = e.dst")
def g21_break_point_costs(t):
    e = G.simple_edges(t.ring)
    into = e.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    both = e.distinct().join(into.select(F.col("node_id").alias("src"), F.col("n").alias("a")), "src").join(into.select(F.col("node_id").alias("dst"), F.col("n").alias("b")), "dst")
    return both.select("src", "dst", F.least("a", "b").alias("cost"))


@query("SELECT doc_id, bytes * 50 AS est_bytes, least(10.0, bytes / 100.0 + impact / 5.0)::DOUBLE AS score, 50 + bytes + 10 * impact AS ms, least(1.0, sessions * 0.1::DOUBLE + least(10.0::DOUBLE, bytes / 100.0::DOUBLE + impact / 5.0::DOUBLE) * 0.05::DOUBLE)::DOUBLE AS risk FROM {registry}")
def g23_step_costs(t):
    c = G.step_costs(F.col("bytes"), F.col("impact"), F.col("sessions"))
    return t.registry.select("doc_id", *(v.alias(k) for k, v in c.items()))


@query("SELECT (SELECT count(*) FROM {registry}) AS nodes, count(*) AS edges, CAST(count(DISTINCT target) AS DOUBLE) / (SELECT count(*) FROM {registry}) AS reachability FROM (SELECT DISTINCT source, target FROM {connections} WHERE resolved AND source <> target)")
def g27_semantic_graph(t):
    e = t.connections.where("resolved and source <> target").select("source", "target").distinct()
    n = t.registry.agg(F.count("*").alias("nodes"))
    g = e.agg(F.count("*").alias("edges"), F.count_distinct("target").alias("hit"))
    return n.join(g).select("nodes", "edges", (F.col("hit") / F.col("nodes")).alias("reachability"))  # one row each


SCOPE = "WITH RECURSIVE u AS (SELECT CAST(9 AS BIGINT) AS node_id UNION SELECT e.dst FROM u JOIN {edges} e ON e.src = u.node_id)"


@query(SCOPE + " SELECT row_number() OVER (ORDER BY CASE n.node_type WHEN 'type' THEN 0 WHEN 'route' THEN 1 WHEN 'file' THEN 3 ELSE 2 END, n.name) - 1 AS position, n.node_id, CASE WHEN n.node_id = 9 THEN 'focal' ELSE 'upstream' END AS side FROM u JOIN {nodes} n USING (node_id)")
def g28_signal_path(t):
    return G.signal_path(t.nodes, t.edges.select("src", "dst"), 9)


@query("SELECT doc_id, CASE WHEN lifecycle = 'archived' THEN 'REDIRECT' WHEN reach < 0.5 THEN 'FAILURE' WHEN sessions > 9 THEN 'AMBIGUOUS' WHEN reach > 0.95 THEN 'SUCCESS' ELSE 'PARTIAL' END AS outcome FROM {registry}")
def g30_outcome(t):
    # more than two ambiguities: sessions beyond nine stand for them here
    o = G.outcome(F.col("reach").cast("double"), F.lit(0.0), F.lit(0), F.col("sessions") - 7, F.col("lifecycle") == "archived")
    return t.registry.select("doc_id", o.alias("outcome"))


@query("""WITH m AS (SELECT c.source_id, c.specifier, b.doc_id IS NOT NULL AS found, a.doc_id % 7 AS k, a.dir = b.dir AS exact FROM {connections} c JOIN {registry} a ON a.doc_id = c.source_id LEFT JOIN {registry} b ON b.doc_id = c.target_id),
 k AS (SELECT *, CASE WHEN NOT found THEN 'MISSING' WHEN k IN (0, 2, 4) THEN 'CONFLICT' WHEN exact THEN 'SAFE' ELSE 'NEEDS_REWRITE' END AS kind FROM m)
SELECT source_id, specifier, kind, CASE kind WHEN 'SAFE' THEN 1.0 WHEN 'NEEDS_REWRITE' THEN 0.7 WHEN 'CONFLICT' THEN 0.3 ELSE 0.0 END::DOUBLE AS confidence FROM k""")
def g31_classify_dependency(t):
    # by k: other signatures; same; no common signature, other result; nothing in common; as many parameters or not; empty texts
    own = ({"signature": "f()", "paramCount": "1"}, {"signature": "f()", "returnType": "a"}, {"signature": "", "returnType": "a", "paramCount": "1"}, {"signature": "f()"}, {"paramCount": "1"}, {"paramCount": "2", "returnType": ""}, {})
    other = ({"signature": "g()", "paramCount": "1"}, {"signature": "f()", "returnType": "b"}, {"signature": "x", "returnType": "b", "paramCount": "1"}, {"returnType": "a"}, {"paramCount": "2"}, {"paramCount": "2", "returnType": "b"}, {"signature": "f()"})

    def meta(maps):
        out = F.lit(None).cast("map<string,string>")
        for i, m in enumerate(maps):
            out = F.when(F.col("k") == i, F.create_map(*(F.lit(x) for kv in m.items() for x in kv)).cast("map<string,string>")).otherwise(out)
        return out

    a = t.registry.select(F.col("doc_id").alias("source_id"), F.col("dir").alias("_a"), (F.col("doc_id") % 7).alias("k"))
    b = t.registry.select(F.col("doc_id").alias("target_id"), F.col("dir").alias("_b"))
    both = t.connections.join(a, "source_id").join(b, "target_id", "left")
    found = I.classified(F.col("_b").isNotNull(), F.col("_a") == F.col("_b"), meta(own), meta(other))
    return both.select("source_id", "specifier", found.alias("x")).select("source_id", "specifier", "x.kind", "x.confidence")


@query(SCOPE + ", d AS (SELECT CAST(9 AS BIGINT) AS node_id UNION SELECT e.src FROM d JOIN {edges} e ON e.dst = d.node_id) SELECT (SELECT count(*) - 1 FROM u) AS upstream, (SELECT count(*) - 1 FROM d) AS downstream")
def g33_scope_counts(t):
    e = t.edges.select("src", "dst")
    up, down = (G.reach(e, _seed(t, 9), outbound=o).agg((F.count("*") - 1).alias(k)) for o, k in ((True, "upstream"), (False, "downstream")))
    return up.join(down)  # one row each


@query("SELECT r.doc_id, CASE WHEN bool_or(coalesce(c.resolved AND c.kind = 'REQUIRE', false)) THEN 'GREEN' ELSE 'RED' END AS status FROM {registry} r LEFT JOIN {connections} c ON c.source_id = r.doc_id GROUP BY r.doc_id")
def g34_classify_basic(t):
    good = t.connections.where("resolved and kind = 'REQUIRE'").select(F.col("source_id").alias("doc_id"), F.lit("GREEN").alias("status")).distinct()
    return t.registry.select("doc_id").join(good, "doc_id", "left").na.fill("RED", ["status"])
