"""Queries of streams (T), sinks (K) and parsers (N, X) over the tables."""

from pyspark.sql import functions as F

from lodestone.functions import source_text as P
from lodestone.registry import query
from lodestone.sources import sinks
from lodestone.streaming import changes as C


def _changes(t):
    return t.mutations.select(F.col("fingerprint").alias("path"), F.lower("kind").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("string").alias("sha"))


BURSTS = """SELECT path, type, start_at FROM (SELECT fingerprint AS path, lower(kind) AS type, ts AS start_at, ts - lag(ts) OVER (PARTITION BY fingerprint, kind ORDER BY ts) AS gap FROM {mutations}) WHERE gap IS NULL OR gap > INTERVAL 60 MINUTE"""


@query(f"SELECT path, type, count(*) AS bursts FROM ({BURSTS}) GROUP BY path, type")
def t02_debounce(t):
    return C.debounce(_changes(t), "60 minutes").groupBy("path", "type").agg(F.count("*").alias("bursts"))


@query("SELECT fingerprint AS path, arg_max(CAST(value AS STRING), (ts, id)) IS NOT NULL AS known FROM {mutations} GROUP BY fingerprint HAVING arg_max(kind, (ts, id)) <> 'ERROR'")
def t03_stateful_apply(t):
    batch = _changes(t).withColumn("type", F.when(F.col("type") == "error", "unlink").otherwise("change"))
    registry = t.spark.createDataFrame([], "path string, sha string")
    return C.apply_batch(registry, batch)[0].select("path", F.col("sha").isNotNull().alias("known"))


@query("SELECT topic, count(*) AS n FROM (SELECT 'mutation' AS topic FROM {mutations} UNION ALL SELECT 'mutation:' || lower(kind) FROM {mutations}) GROUP BY topic")
def t05_topics(t):
    return C.topics(t.mutations.select(F.col("fingerprint").alias("path"), "kind")).groupBy("topic").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT c.source, string_agg(c.specifier || '>' || coalesce(r.filepath, '?'), ',' ORDER BY c.specifier, r.filepath NULLS FIRST) AS imports FROM {connections} c LEFT JOIN {registry} r ON r.fingerprint = c.target GROUP BY c.source),
 i AS (SELECT c.target, array_to_string(list_sort(list_distinct(list(coalesce(r.filepath, c.source)))), ',') AS importers FROM {connections} c LEFT JOIN {registry} r ON r.fingerprint = c.source GROUP BY c.target)
SELECT r.fingerprint, r.filepath, r.status, coalesce(o.imports, '') AS imports, coalesce(i.importers, '') AS imported_by FROM {registry} r LEFT JOIN o ON o.source = r.fingerprint LEFT JOIN i ON i.target = r.fingerprint""")
def k02_manifest(t):
    doc = sinks.manifest(t.registry.select("fingerprint", "filepath", "status"), t.connections)
    kind = "filepath string, status string, imports array<struct<specifier:string,target_path:string>>, importedBy array<string>"
    x = F.from_json("json", kind)
    imports = F.array_join(F.transform(x["imports"], lambda i: F.concat(i["specifier"], F.lit(">"), F.coalesce(i["target_path"], F.lit("?")))), ",")
    return doc.select("fingerprint", x["filepath"].alias("filepath"), x["status"].alias("status"), imports.alias("imports"), F.array_join(x["importedBy"], ",").alias("imported_by"))


@query("""SELECT filepath, '[[file]]' || chr(10) || 'path = "' || filepath || '"' || chr(10) || 'status = "' || status || '"' || chr(10) || 'can_be_archived = ' || CASE WHEN status = 'RED' AND impact = 0 THEN 'true' ELSE 'false' END || chr(10) AS toml FROM {registry}""")
def k03_toml_manifest(t):
    return sinks.toml_lines(t.registry)


@query("SELECT name FROM (SELECT filepath || '.' || lpad(CAST(birth AS STRING), 4, '0') AS name, row_number() OVER (PARTITION BY split_part(filepath, '.', 1) ORDER BY birth DESC) AS k FROM {versions}) WHERE k <= 2")
def k07_keep_newest(t):
    return sinks.keep_newest(t.versions.select(F.concat("filepath", F.lit("."), F.lpad(F.col("birth").cast("string"), 4, "0")).alias("name")), 2)


@query("""WITH n AS (SELECT path, row_number() OVER (ORDER BY path) AS id FROM {nodes}), e AS (SELECT e.edge_id, a.path AS src, CASE WHEN e.edge_id % 11 = 0 THEN 'unknown' ELSE b.path END AS dst FROM {edges} e JOIN {nodes} a ON a.node_id = e.src JOIN {nodes} b ON b.node_id = e.dst)
SELECT edge_id, x.id AS src, y.id AS dst FROM e JOIN n x ON x.path = e.src JOIN n y ON y.path = e.dst""")
def k13_assign_ids(t):
    at = t.nodes.select("node_id", "path")
    ends = t.edges.join(at.toDF("src", "_a"), "src").join(at.toDF("dst", "_b"), "dst")
    named = ends.select("edge_id", F.col("_a").alias("src"), F.when(F.col("edge_id") % 11 == 0, "unknown").otherwise(F.col("_b")).alias("dst"))
    return sinks.assign_ids(t.nodes.select(F.col("path").alias("id")), named)[1].select("edge_id", "src", "dst")


@query("SELECT dir, '' AS name, 'files of ' || dir || ':' AS line FROM {registry} GROUP BY dir UNION ALL SELECT dir, filename, filename || ' ' || status FROM {registry}")
def k20_context_lines(t):
    return sinks.context_lines(t.registry)


@query("SELECT name, 'file' AS node_type FROM (SELECT DISTINCT filepath AS name FROM {registry})")
def n01_file_nodes(t):
    # a report, a row a file: no task holds the whole of a project's
    reports = t.registry.select(F.col("dir").alias("project"), F.concat((F.col("doc_id") + 1).cast("string"), F.lit(": "), "filepath").alias("text"))
    return P.report_nodes(reports, "file").select("name", "node_type")


CODE = [  # code, cyclomatic, cognitive, lines
    ("return 1;", 1, 0, 1), ("if (a) {\n  for (;;) {\n    if (b && c) x();\n  }\n}", 5, 7, 5), ("switch (a) {\n case 1:\n case 2: while (b) {}\n}", 5, 3, 4), ("try {\n} catch (e) {\n  do { } while (a || b)\n}", 4, 4, 4), ("}}\nif (a) { }", 2, 1, 2), ("", 1, 0, 1),
]
_said = lambda k: " ".join(f"WHEN {i} THEN {r[k]}" for i, r in enumerate(CODE))


@query(f"SELECT doc_id, CASE doc_id % 7 {_said(1)} END AS cyclomatic, CASE doc_id % 7 {_said(2)} END AS cognitive, CASE doc_id % 7 {_said(3)} END AS lines FROM {{registry}}")
def x11_complexity(t):
    text = F.lit(None).cast("string")
    for i, row in enumerate(CODE):
        text = F.when(F.col("doc_id") % 7 == i, row[0]).otherwise(text)
    return t.registry.select("doc_id", P.complexity(text).alias("x")).select("doc_id", "x.*")


CHAIN_NAMES = "SELECT filepath AS path, 'v' || CAST(doc_id AS STRING) AS name FROM {registry} WHERE doc_id % 2 = 0"
CHAIN_REEXPORTS = """SELECT a.filepath AS path, 1 AS ordinal, 'v' || CAST(a.doc_id + 1 AS STRING) AS name, 'v' || CAST(b.doc_id AS STRING) AS local, b.filepath AS target FROM {registry} a JOIN {registry} b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 9 < 7"""
CHAIN_STARS = "SELECT a.filepath AS path, 0 AS ordinal, b.filepath AS target FROM {registry} a JOIN {registry} b ON b.doc_id = a.doc_id + 2 WHERE a.doc_id % 8 IN (1, 3)"
CHAIN_WANTED = "SELECT a.filepath AS path, 'v' || CAST(a.doc_id + k.k AS STRING) AS name FROM {registry} a CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k"


@query(f"""WITH RECURSIVE own AS ({CHAIN_NAMES}), re AS ({CHAIN_REEXPORTS}), stars AS ({CHAIN_STARS}), wanted AS ({CHAIN_WANTED}),
 every AS (SELECT path, name FROM own UNION SELECT path, name FROM re),
 l1 AS (SELECT s.path, e.name FROM stars s JOIN every e ON e.path = s.target), l2 AS (SELECT s.path, e.name FROM stars s JOIN l1 e ON e.path = s.target), l3 AS (SELECT s.path, e.name FROM stars s JOIN l2 e ON e.path = s.target),
 there AS (SELECT * FROM every UNION SELECT * FROM l1 UNION SELECT * FROM l2 UNION SELECT * FROM l3),
 step AS (SELECT path, name, arg_min(target, ordinal) AS target, arg_min(local, ordinal) AS local FROM (SELECT path, ordinal, name, local, target FROM re UNION ALL SELECT path, ordinal, local, local, target FROM re WHERE local <> name
   UNION ALL SELECT s.path, s.ordinal, t.name, t.name, s.target FROM stars s JOIN there t ON t.path = s.target) GROUP BY path, name),
 walk AS (SELECT path, name, path AS at, name AS called, [path] AS chain FROM wanted UNION ALL SELECT w.path, w.name, s.target, s.local, list_append(w.chain, s.target) FROM walk w JOIN step s ON s.path = w.at AND s.name = w.called WHERE len(w.chain) <= 5 AND NOT list_contains(w.chain, s.target))
SELECT path, name, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM walk GROUP BY path, name""")
def x14_export_chains(t):
    found = P.export_chains(t.sql(CHAIN_WANTED), t.sql(CHAIN_REEXPORTS), t.sql(CHAIN_STARS), t.sql(CHAIN_NAMES))
    return found.select("path", "name", F.array_join("chain", ">").alias("chain"))


@query("SELECT page_id, 'js' AS kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'track\\(\\d+\\)')) AS c FROM {links}) GROUP BY page_id")
def x11_calls(t):
    calls = F.regexp_extract_all("html", F.lit(r"track\(\d+\)"), F.lit(0))
    return t.links.select("page_id", F.lit("js").alias("kind"), F.size(calls).cast("long").alias("n")).where("n > 0")
