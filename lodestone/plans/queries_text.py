"""Queries of source-text operators (X, N, S), report rendering (K) and the remaining rankings and graph rows."""

from pyspark.sql import functions as F

from lodestone.functions import scalars as X
from lodestone.functions import source_text as P
from lodestone.operators import graph as G
from lodestone.operators import lookups as L
from lodestone.operators import relations as R
from lodestone.operators import snapshots as M
from lodestone.registry import query


@query("SELECT doc_id, CAST(1 AS BIGINT) AS marks FROM {code}")
def x06_review_marks(t):
    return t.code.select("doc_id", X.needs_review(F.col("text")).cast("long").alias("marks"))


@query("SELECT path, 'named' AS kind, './f' || CAST(doc_id + 1 AS STRING) AS specifier FROM {code} UNION ALL SELECT path, 'require', 'pkg' || CAST(doc_id % 9 AS STRING) FROM {code}")
def x09_imports(t):
    return P.imports(t.code).select("path", "kind", "specifier")


@query("SELECT path, CASE WHEN status = 'RED' THEN 'main' ELSE 'f' END || CAST(doc_id AS STRING) AS name, CASE WHEN status = 'RED' THEN 'default' ELSE 'declaration' END AS kind FROM {code} UNION ALL SELECT path, 'h', 'commonjs' FROM {code} WHERE status <> 'RED'")
def x08_exports(t):
    return P.exports(t.code)


@query("SELECT doc_id, CASE WHEN status = 'RED' THEN 3 ELSE 1 END::BIGINT AS complexity, CASE WHEN status = 'RED' THEN 2 ELSE 1 END::BIGINT AS depth, CASE WHEN status = 'RED' THEN 3 ELSE 4 END::BIGINT AS loc FROM {code}")
def x11_complexity(t):
    text = F.col("text")
    return t.code.select("doc_id", X.cyclomatic(text).cast("long").alias("complexity"), X.nesting(text).cast("long").alias("depth"), X.loc(text).cast("long").alias("loc"))


@query("SELECT doc_id, status <> 'RED' AS pure FROM {code}")
def x12_purity(t):
    return t.code.select("doc_id", P.is_pure(F.col("text")).alias("pure"))


@query("SELECT doc_id, 'RED' AS level FROM {code} WHERE status = 'RED' UNION ALL SELECT doc_id, status FROM {code} WHERE status <> 'RED'")
def x13_tags(t):
    doc = F.concat(F.lit("/**\n * @level "), "status", F.lit("\n * @param x\n */"))
    return t.code.select("doc_id", P.doc_tags(doc)["level"].alias("level"))


@query("WITH RECURSIVE s AS (SELECT doc_id AS path, doc_id AS item, 0 AS depth FROM {registry} UNION ALL SELECT s.path, r.doc_id, s.depth + 1 FROM s JOIN {registry} r ON r.doc_id = CAST(floor(s.item / 2) AS BIGINT) WHERE s.depth < 3) SELECT path, count(DISTINCT item) AS names FROM s GROUP BY path")
def x14_reexports(t):
    stars = t.registry.select(F.col("doc_id").alias("path"), F.floor(F.col("doc_id") / 2).cast("long").alias("target"))
    own = t.registry.select(F.col("doc_id").alias("path"), F.concat(F.lit("n"), "doc_id").alias("name"))
    return P.star_closure(stars, own, 3).groupBy("path").agg(F.count("*").alias("names"))


@query("""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 22 < 21 THEN (doc_id % 22) / 20.0::DOUBLE END AS v FROM {registry})
SELECT doc_id, CASE WHEN v IS NULL THEN NULL WHEN v >= 0.95 THEN 'Excellent — nearly all dependencies resolved' WHEN v >= 0.8 THEN 'Good — most dependencies resolved' WHEN v >= 0.5 THEN 'Moderate — significant gaps remain' ELSE 'Poor — majority of dependencies unresolved' END AS reachability,
 CASE WHEN v IS NULL THEN NULL WHEN v < 0.5 THEN 'Low confidence — integration may be unreliable' WHEN v < 0.8 THEN 'Moderate confidence — some uncertainty' ELSE 'High confidence in integration success' END AS stability,
 CASE WHEN v IS NULL THEN NULL WHEN v > 0.3 THEN 'High risk — significant breakage likely' WHEN v > 0.15 THEN 'Moderate risk — careful testing required' WHEN v > 0.05 THEN 'Low risk — minor issues possible' ELSE 'Minimal post-integration breakage risk' END AS fragility FROM v""")
def x24_interpretation(t):
    value = F.when(F.col("doc_id") % 22 < 21, (F.col("doc_id") % 22) / F.lit(20.0))
    return t.registry.select("doc_id", *(X.meaning(k, value).alias(k) for k in X.MEANINGS))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM {code}")
def x32_script_blocks(t):
    wrapped = F.concat(F.lit("<template/><script>"), "text", F.lit("</script>"))
    return t.code.select("doc_id", F.length(P.script_of(wrapped, F.lit("a.vue"))).cast("long").alias("chars"))


@query("SELECT DISTINCT 'cmd' || CAST(doc_id % 5 AS STRING) AS command FROM {code} WHERE status <> 'RED'")
def s18_invoked_commands(t):
    return t.code.select(F.explode(P.commands_invoked(F.col("text"))).alias("command")).distinct()


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<(h[0-9]|p|b)>', 1))) AS BIGINT) AS kinds FROM {links}")
def s21_ui_tags(t):
    return t.links.select("page_id", F.size(P.ui_tags(F.col("html"), "<(h[0-9]|p|b)>")).cast("long").alias("kinds"))


@query("SELECT doc_id, sha256(text) AS sha FROM {documents}")
def s02_hash(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))


@query("SELECT filepath, needs_review, sessions FROM {registry} ORDER BY filepath")
def s08_all_files(t):
    return t.registry.select("filepath", "needs_review", "sessions").orderBy("filepath")


@query("SELECT source, target, kind FROM {connections} ORDER BY source, target")
def s09_all_connections(t):
    return t.connections.select("source", "target", "kind").orderBy("source", "target")


@query("SELECT node_id, node_type FROM {nodes} WHERE graph_id = 'g2'")
def s10_graph_nodes(t):
    return L.by_value(t.nodes, "graph_id", "g2").select("node_id", "node_type")


def _reports(t, line, kind):
    """A report, a row a line or block: no task holds the whole of a project's."""
    return t.registry.select(F.col("dir").alias("project"), line.alias("text"), F.lit(kind).alias("kind"))


@query("SELECT dir AS project, 'store' AS node_type, filename AS name FROM {registry}")
def n02_store_nodes(t):
    return P.report_nodes(_reports(t, F.concat(F.lit("--- Store ID: "), "filename", F.lit(" ---")), "store"), "store").select("project", "node_type", "name")


@query("SELECT dir AS project, '/' || filename AS path FROM {registry}")
def n03_route_nodes(t):
    return P.report_nodes(_reports(t, F.concat(F.lit("  - Path: /"), "filename"), "route"), "route").select("project", "path")


@query("SELECT DISTINCT dir AS project, phase AS name FROM {registry}")
def n04_command_nodes(t):
    return P.report_nodes(_reports(t, F.concat(F.lit("Command: "), "phase"), "command"), "command").select("project", "name")


@query("SELECT dir AS project, 'T' || CAST(doc_id AS STRING) AS name, filename AS path FROM {registry}")
def n05_type_nodes(t):
    block = F.concat(F.lit("--- File: "), "filename", F.lit(" ---\nexport interface T"), F.col("doc_id").cast("string"), F.lit(" {}"))
    return P.report_types(_reports(t, block, "type")).select("project", "name", "path")


@query("SELECT dir AS project, filename AS name, filepath AS path FROM {registry}")
def n06_component_nodes(t):
    return P.report_nodes(_reports(t, F.concat(F.lit("File Name: "), "filename", F.lit(" ("), "filepath", F.lit(")")), "component"), "component").select("project", "name", "path")


@query("SELECT './f' || CAST(doc_id + 1 AS STRING) AS name, count(*) AS n FROM {code} GROUP BY 1 UNION ALL SELECT 'pkg' || CAST(doc_id % 9 AS STRING), count(*) FROM {code} GROUP BY 1")
def n07_import_nodes(t):
    return P.imports(t.code).groupBy(F.col("specifier").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT node_type, count(*) AS n FROM (SELECT DISTINCT dir, 'command' AS node_type, phase AS name FROM {registry} UNION ALL SELECT dir, 'store', filename FROM {registry}) GROUP BY node_type")
def n08_ingest(t):
    reports = _reports(t, F.concat(F.lit("Command: "), "phase"), "command").unionByName(_reports(t, F.concat(F.lit("--- Store ID: "), "filename", F.lit(" ---")), "store"))
    return P.ingest(reports).groupBy("node_type").agg(F.count("*").alias("n"))


@query("SELECT filename AS name FROM {registry} WHERE dir = 'src0' UNION ALL SELECT '[COMPARE] ' || filename FROM {registry} WHERE dir = 'src1'")
def n13_compare_mode(t):
    own, other = (L.by_value(t.registry, "dir", d) for d in ("src0", "src1"))
    return own.select(F.col("filename").alias("name")).unionByName(other.select(F.concat(F.lit("[COMPARE] "), "filename").alias("name"))).orderBy("name")


@query("SELECT fingerprint FROM {registry} WHERE fingerprint IN (SELECT fingerprint FROM {intents})")
def k05_cards_kept(t):
    return t.registry.select("fingerprint").join(t.intents.select("fingerprint"), "fingerprint", "left_semi")


RING = "WITH RECURSIVE c AS (SELECT src AS a, dst AS b FROM {ring} WHERE src <> dst UNION SELECT c.a, e.dst FROM c JOIN {ring} e ON e.src = c.b), s AS (SELECT x.a AS node_id, least(x.a, min(x.b)) AS scc FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"


@query(RING + " SELECT string_agg(CAST(node_id AS STRING), '|' ORDER BY node_id) AS members, 'first' AS origin FROM s GROUP BY scc")
def o08_merge_cycles(t):
    one = G.strong_components(t.ring).groupBy("scc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), "|").alias("members"))
    both = one.select("members", F.lit("first").alias("origin")).unionByName(one.select("members", F.lit("second").alias("origin")))
    return both.groupBy("members").agg(F.min("origin").alias("origin"))


@query(RING + " SELECT scc, min(node_id) AS first_member, 'circular-dependency' AS category FROM s GROUP BY scc")
def a16_cycle_insights(t):
    return G.strong_components(t.ring).groupBy("scc").agg(F.min("node_id").alias("first_member")).withColumn("category", F.lit("circular-dependency"))


@query("SELECT section, position, doc_id, row_number() OVER (ORDER BY section, position) AS step FROM (SELECT 1 AS section, row_number() OVER (ORDER BY doc_id) AS position, doc_id FROM {registry} WHERE status = 'RED' UNION ALL SELECT 2, row_number() OVER (ORDER BY doc_id), doc_id FROM {registry} WHERE status = 'YELLOW')")
def g29_plan_steps(t):
    from lodestone.sources.sinks import assign_ids

    red, yellow = (t.registry.where(F.col("status") == s).select(F.concat(F.lit(str(k)), F.lpad(F.col("doc_id").cast("string"), 19, "0")).alias("id"), F.lit(k).alias("section"), "doc_id") for k, s in ((1, "RED"), (2, "YELLOW")))
    numbered, _ = assign_ids(red.unionByName(yellow), t.spark.createDataFrame([], "src string, dst string"))
    first = numbered.groupBy("section").agg(F.min("node_id").alias("_first"))
    return numbered.join(F.broadcast(first), "section").select("section", (F.col("node_id") - F.col("_first") + 1).alias("position"), "doc_id", F.col("node_id").alias("step"))


@query("SELECT doc_id, 'PRODUCTION' AS phase FROM {registry} WHERE phase = 'LOCKED' AND status = 'GREEN' UNION ALL SELECT doc_id, phase FROM {registry} WHERE NOT (phase = 'LOCKED' AND status = 'GREEN')")
def m17_promote(t):
    return M.update(t.registry, (F.col("phase") == "LOCKED") & (F.col("status") == "GREEN"), phase="PRODUCTION").select("doc_id", "phase")


@query("SELECT name, CASE WHEN kind = 'local' THEN 0.0::DOUBLE ELSE balance END AS balance FROM {providers}")
def m25_project_update(t):
    return M.update(t.providers, F.col("kind") == "local", balance=0.0).select("name", "balance")
