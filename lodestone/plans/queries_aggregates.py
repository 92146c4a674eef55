"""Queries of aggregates (A)."""

from pyspark.sql import functions as F

from lodestone.operators import aggregates as A
from lodestone.operators import gaps
from lodestone.registry import query


@query("SELECT n.graph_id, count(*) AS nodes, min(n.node_id) AS first_node, (SELECT count(*) FROM {edges} e WHERE e.graph_id = n.graph_id) AS edges FROM {nodes} n GROUP BY n.graph_id")
def a01_list_graphs(t):
    edges = t.edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
    nodes = t.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.min("node_id").alias("first_node"))
    return nodes.join(edges, "graph_id", "left").na.fill(0, ["edges"])


@query("SELECT category, count(*) AS n FROM {insights} GROUP BY category")
def a02_category_summary(t):
    return t.insights.groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM {tickets} WHERE resolved IS NULL")
def a03_open_ticket_count(t):
    return t.tickets.where("resolved is null").agg(F.count("*").alias("n"))


@query("SELECT fingerprint, count(*) AS n FROM {mutations} GROUP BY fingerprint")
def a04_mutation_counts(t):
    return t.mutations.groupBy("fingerprint").agg(F.count("*").alias("n"))


@query("SELECT sum(CASE WHEN status = 'GREEN' THEN 1 ELSE 0 END)::BIGINT AS green, sum(CASE WHEN status = 'YELLOW' THEN 1 ELSE 0 END)::BIGINT AS yellow, sum(CASE WHEN status = 'RED' THEN 1 ELSE 0 END)::BIGINT AS red FROM {registry}")
def a05_status_counts(t):
    return A.status_counts(t.registry)


@query("SELECT file_id, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM {insights} GROUP BY file_id")
def a06_categories_per_file(t):
    return t.insights.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("SELECT file_id, count(*) AS total, max(pass_number) AS last_pass, arg_max(id, (ts, id)) AS last_id FROM {insights} GROUP BY file_id")
def a07_slot_counters(t):
    return t.insights.groupBy("file_id").agg(F.count("*").alias("total"), F.max("pass_number").alias("last_pass"), F.max_by("id", F.struct("ts", "id")).alias("last_id"))


@query("SELECT CASE r.doc_id % 9 WHEN 8 THEN 'UNKNOWN' ELSE phase END AS phase, count(*) AS n, count(CASE WHEN (i.purpose <> '' OR i.worth <> '') AND (r.doc_id % 9 = 8 OR phase <> 'PRODUCTION') THEN 1 END) AS can_progress FROM {registry} r LEFT JOIN {intents} i ON i.fingerprint = r.fingerprint GROUP BY 1")
def a08_phase_distribution(t):
    phase = F.when(F.col("doc_id") % 9 == 8, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.col("phase"))
    cards = t.registry.join(t.intents, "fingerprint", "left").select(phase.alias("lifecyclePhase"), F.struct("purpose", F.col("worth").alias("valueStatement")).alias("intent"))
    return gaps.phases(cards)


@query("SELECT status, count(*) AS n, sum(CASE WHEN status = 'RED' AND impact = 0 THEN 1 ELSE 0 END)::BIGINT AS isolated, sum(CASE WHEN status = 'RED' AND quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled, sum(CASE WHEN status = 'GREEN' AND reach < 0.3 THEN 1 ELSE 0 END)::BIGINT AS low_reach FROM {registry} GROUP BY status")
def a09_status_root_causes(t):
    red = F.col("status") == "RED"
    causes = {"isolated": red & (F.col("impact") == 0), "unlabelled": red & F.col("quality").isNull(), "low_reach": (F.col("status") == "GREEN") & (F.col("reach") < 0.3)}
    return t.registry.groupBy("status").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in causes.items()))


@query("SELECT r.dir, count(*) AS total, count(CASE WHEN trim(i.purpose) NOT IN ('', '(not set)') THEN 1 END) AS with_intent, printf('%.1f', floor(count(CASE WHEN trim(i.purpose) NOT IN ('', '(not set)') THEN 1 END) * 1000.0 / count(*) + 0.5) / 10) AS coverage FROM {registry} r LEFT JOIN {intents} i USING (fingerprint) GROUP BY r.dir")
def a10_intent_coverage(t):
    real = F.coalesce(~F.trim("purpose").isin("", "(not set)"), F.lit(False))
    g = t.registry.join(t.intents, "fingerprint", "left").groupBy("dir").agg(F.count("*").alias("total"), F.count_if(real).alias("with_intent"))
    return g.withColumn("coverage", A.percent(F.col("with_intent"), F.col("total")))


@query("SELECT r.dir, count(DISTINCT c.source) AS importing, count(CASE WHEN c.kind = 'REQUIRE' THEN 1 END) AS cjs, count(CASE WHEN c.kind = 'IMPORT' THEN 1 END) AS esm FROM {registry} r LEFT JOIN {connections} c ON c.source = r.fingerprint GROUP BY r.dir")
def a11_export_coverage(t):
    c = t.connections.groupBy(F.col("source").alias("fingerprint")).agg(F.count_if(F.col("kind") == "REQUIRE").alias("cjs"), F.count_if(F.col("kind") == "IMPORT").alias("esm"))
    return t.registry.select("dir", "fingerprint").join(c, "fingerprint", "left").groupBy("dir").agg(F.count("cjs").alias("importing"), F.coalesce(F.sum("cjs"), F.lit(0)).alias("cjs"), F.coalesce(F.sum("esm"), F.lit(0)).alias("esm"))


@query("SELECT count(*) AS imports, count(CASE WHEN resolved THEN 1 END) AS resolved, count(CASE WHEN NOT resolved THEN 1 END) AS orphan, (SELECT count(*) FROM {registry} r WHERE r.fingerprint NOT IN (SELECT source FROM {connections}) AND r.fingerprint NOT IN (SELECT target FROM {connections})) AS isolated FROM {connections}")
def a12_connection_totals(t):
    ends = t.connections.select(F.col("source").alias("fingerprint")).union(t.connections.select("target"))
    isolated = t.registry.join(ends, "fingerprint", "left_anti").agg(F.count("*").alias("isolated"))
    totals = t.connections.agg(F.count("*").alias("imports"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("orphan"))
    return totals.join(isolated)  # one row each


@query("SELECT p.p_type AS component, count(*) AS n, CAST(count(CASE WHEN p.p_size > 25 THEN 1 END) AS DOUBLE) / count(*) AS ratio FROM {part} p GROUP BY p.p_type")
def a13_component_coverage(t):
    return t.part.groupBy(F.col("p_type").alias("component")).agg(F.count("*").alias("n"), (F.count_if(F.col("p_size") > 25) / F.count("*")).alias("ratio"))


LADDER = """SELECT filepath, 'orphan' AS category, 'error' AS severity FROM {registry} WHERE status = 'RED' AND impact = 0
  UNION ALL SELECT filepath, 'broken', 'error' FROM {registry} WHERE status = 'RED' AND impact > 0
  UNION ALL SELECT filepath, 'under-connected', 'warning' FROM {registry} WHERE status = 'YELLOW'
  UNION ALL SELECT filepath, 'under-imported', 'warning' FROM {registry} WHERE status = 'GREEN' AND reach < 0.3
  UNION ALL SELECT filepath, 'high-impact', 'info' FROM {registry} WHERE impact > 20"""


@query(LADDER)
def a14_file_insights(t):
    return A.insights_of(t.registry)


@query(f"SELECT category, severity, count(*) AS n FROM ({LADDER}) GROUP BY category, severity")
def a15_insight_counts(t):
    return A.insights_of(t.registry).groupBy("category", "severity").agg(F.count("*").alias("n"))


HEALTH = """SELECT n.node_id, n.node_type, coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree FROM {nodes} n
  LEFT JOIN (SELECT dst AS node_id, count(*) AS n FROM {edges} WHERE src <> dst GROUP BY dst) i USING (node_id) LEFT JOIN (SELECT src AS node_id, count(*) AS n FROM {edges} WHERE src <> dst GROUP BY src) o USING (node_id)"""


@query(f"SELECT CASE WHEN indegree + outdegree = 0 THEN 'unused' WHEN node_type <> 'file' AND indegree = 0 THEN 'partial' ELSE 'healthy' END AS health, count(*) AS n FROM ({HEALTH}) GROUP BY 1")
def a17_graph_health_buckets(t):
    from lodestone.operators import graph as G

    return G.health(t.nodes, t.edges).groupBy("health").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(count(CASE WHEN indegree > 0 THEN 1 END) AS DOUBLE) / count(*) AS reachability, CAST(count(CASE WHEN outdegree > 0 THEN 1 END) AS DOUBLE) / count(*) AS stability, max(indegree) AS most FROM ({HEALTH})")
def a18_graph_properties(t):
    from lodestone.operators import graph as G

    d = G.degrees(t.nodes, t.edges)
    return d.agg((F.count_if(F.col("indegree") > 0) / F.count("*")).alias("reachability"), (F.count_if(F.col("outdegree") > 0) / F.count("*")).alias("stability"), F.max("indegree").alias("most"))


@query("SELECT (SELECT CAST(count(DISTINCT target) AS DOUBLE) FROM {connections} WHERE resolved) / (SELECT count(*) FROM {registry}) AS reachability, (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT source, target FROM {connections} WHERE source <> target) a JOIN (SELECT DISTINCT source, target FROM {connections}) b ON a.source = b.target AND a.target = b.source) / (SELECT count(*) FROM (SELECT DISTINCT source, target FROM {connections} WHERE source <> target)) AS mutual")
def a19_signal_properties(t):
    pairs = t.connections.where("source <> target").select("source", "target").distinct()
    back = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("back"))
    mutual = pairs.join(back, ["source", "target"], "left").agg((F.count("back") / F.count("*")).alias("mutual"))
    hit = t.connections.where("resolved").agg(F.count_distinct("target").alias("hit"))
    files = t.registry.agg(F.count("*").alias("files"))
    return hit.join(files).join(mutual).select((F.col("hit") / F.col("files")).alias("reachability"), "mutual")  # one row each


@query("SELECT edge_type, count(*) AS edges, count(DISTINCT dst) AS targets, count(CASE WHEN status = 'CONFLICT' THEN 1 END) AS errors, count(CASE WHEN status IS NULL THEN 1 END) AS ambiguous FROM {edges} GROUP BY edge_type")
def a20_data_flow_metrics(t):
    return t.edges.groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("targets"), F.count_if(F.col("status") == "CONFLICT").alias("errors"), F.count_if(F.col("status").isNull()).alias("ambiguous"))


@query("SELECT dst, count(*) AS n, CASE WHEN count(*) > 25 THEN 'high' ELSE 'medium' END AS level FROM {edges} GROUP BY dst HAVING count(*) > 15")
def a21_heavy_imports(t):
    n = t.edges.groupBy("dst").agg(F.count("*").alias("n")).where("n > 15")
    return n.withColumn("level", F.when(F.col("n") > 25, "high").otherwise("medium"))


WEIGHT = "SELECT x.name, coalesce(w.weight, 0) AS weight FROM (SELECT DISTINCT p_brand AS name FROM {part}) x LEFT JOIN (SELECT name, sum(n)::BIGINT AS weight FROM (SELECT unnest(list_distinct(string_split(source, '/'))) AS name, n FROM (SELECT p_type || '/' || p_brand AS source, count(*) AS n FROM {part} WHERE p_size > 48 GROUP BY 1)) GROUP BY name) w USING (name)"


def _weights(t):
    imports = t.part.where("p_size > 48").groupBy(F.concat_ws("/", "p_type", "p_brand").alias("source")).agg(F.count("*").alias("n"))
    return A.dependency_weight(imports, t.part.select(F.col("p_brand").alias("name")).distinct())


@query(f"SELECT name FROM ({WEIGHT}) WHERE weight = 0")
def a22_unused_exports(t):
    return _weights(t).where((F.col("weight") == 0) & (F.col("name") != "default")).select("name")


@query(WEIGHT)
def a23_dependency_weight(t):
    return _weights(t)


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN d.k IS NULL THEN 'MISSING' WHEN r.k IS NULL THEN 'ORPHAN' WHEN d.sha <> r.sha THEN 'MODIFIED' ELSE 'VERIFIED' END AS state FROM (SELECT doc_id AS k, sha256(text) AS sha FROM {documents} WHERE n_chars > 200) d FULL JOIN (SELECT doc_id AS k, CASE WHEN source = 'src3' THEN '' ELSE sha256(text) END AS sha FROM {documents} WHERE n_chars < 5000) r ON d.k = r.k) GROUP BY state")
def a24_verify(t):
    sha = t.documents.select(F.col("doc_id").alias("filepath"), F.sha2("text", 256).alias("sha"), "n_chars", "source")
    registry = sha.where("n_chars < 5000").withColumn("sha", F.when(F.col("source") == "src3", "").otherwise(F.col("sha")))
    return A.verify(sha.where("n_chars > 200").select("filepath", "sha"), registry.select("filepath", "sha")).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT fingerprint, count(*) AS attempts, CAST(count(CASE WHEN kind <> 'ERROR' THEN 1 END) AS DOUBLE) / count(*) AS success, count(CASE WHEN kind = 'ERROR' THEN 1 END) AS errors FROM {mutations} GROUP BY fingerprint")
def a25_parser_health(t):
    bad = F.col("kind") == "ERROR"
    return t.mutations.groupBy("fingerprint").agg(F.count("*").alias("attempts"), (F.count_if(~bad) / F.count("*")).alias("success"), F.count_if(bad).alias("errors"))


@query("SELECT kind, count(*) AS n FROM {mutations} WHERE kind NOT IN ('PURCHASE') GROUP BY kind")
def a26_prune_counts(t):
    return t.mutations.where(~F.col("kind").isin("PURCHASE")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT phase, sum(bytes)::BIGINT AS total, max(bytes) AS longest, CAST(sum(bytes) AS DOUBLE) / max(bytes) AS speedup FROM {registry} GROUP BY phase")
def a27_step_durations(t):
    return t.registry.groupBy("phase").agg(F.sum("bytes").alias("total"), F.max("bytes").alias("longest"), (F.sum("bytes") / F.max("bytes")).alias("speedup"))


@query("SELECT doc_id, CASE WHEN s < 0.2 THEN 'low' WHEN s < 0.6 THEN 'medium' WHEN s < 1.0 THEN 'high' ELSE 'critical' END AS band FROM (SELECT doc_id, (1 - CAST(reach AS DOUBLE)) + (1 - CAST(0.5 AS DOUBLE)) + impact / 100.0::DOUBLE + sessions * CAST(0.1 AS DOUBLE) AS s FROM {registry})")
def a28_risk_bands(t):
    band = A.risk_band(F.col("reach").cast("double"), F.lit(0.5), F.col("impact") / 100.0, F.col("sessions"))[1]
    return t.registry.select("doc_id", band.alias("band"))


@query("SELECT severity, count(*) AS n, count(CASE WHEN category = 'error' THEN 1 END) AS errors FROM {insights} GROUP BY severity")
def a29_level_rollup(t):
    return t.insights.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "error").alias("errors"))


@query("SELECT p_name AS name, count(*) AS exports, count(DISTINCT p_brand) AS paths FROM {part} GROUP BY p_name")
def a31_exports_by_name(t):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("exports"), F.count_distinct("p_brand").alias("paths"))
