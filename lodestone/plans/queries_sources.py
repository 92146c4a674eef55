"""Queries of sources (S), sinks (K), snapshots (M), search (H), streams (T) and the remaining scalar and parser operators.

Those that write do so below the session's checkpoint folder, and read back what they wrote.
"""

import uuid

from pyspark.sql import functions as F

from lodestone.functions import literals as J
from lodestone.functions import scalars as X
from lodestone.functions import source_text as P
from lodestone.operators import search as H
from lodestone.operators import snapshots as M
from lodestone.operators.lineage import checkpoint_folder
from lodestone.plans.views import BASE
from lodestone.registry import query
from lodestone.sources import cache as Q
from lodestone.sources import files as S
from lodestone.sources import sinks as K
from lodestone.streaming import changes as C

NAMES = sorted(BASE)
_values = lambda rows: " UNION ALL ".join(rows)


def _folder(t):
    return f"{checkpoint_folder(t.spark)}/query-{uuid.uuid4().hex}"


# sources


@query(_values(f"SELECT '{n}.parquet' AS path, true AS filled" for n in NAMES))
def s01_scan(t):
    return S.whole(S.scan(t.spark, t.sf_dir, extensions=(".parquet",))).select("path", (F.col("bytes") > 0).alias("filled"))


@query("SELECT 'documents.parquet' AS path")
def s03_scan_without(t):
    return S.whole(S.scan(t.spark, t.sf_dir, extensions=(".parquet",), own=tuple(f"{n}.parquet" for n in NAMES if n != "documents"))).select("path")


@query(_values(f"SELECT '{n}.parquet' AS path" for n in NAMES))
def s05_listing(t):
    return S.listing(t.spark, t.sf_dir).where(F.col("path").endswith(".parquet")).select("path")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'card' ELSE 'none' END AS kind, fingerprint, filepath FROM {registry} WHERE doc_id % 2 = 0")
def s06_schema_cards(t):
    folder = _folder(t)
    K.write_cards(t.registry.where("doc_id % 2 = 0").select("fingerprint", "filepath", "status"), folder)
    t.spark.createDataFrame([("{not json",), ('{"status": "RED"}',)], "value string").write.mode("append").text(folder)
    return S.cards(t.spark, folder, lines=True).select(F.lit("card").alias("kind"), "fingerprint", "filepath")


@query("SELECT CAST(n_nationkey AS INT) AS step, CASE WHEN n_regionkey % 2 = 0 THEN 'copy' ELSE 'rewrite' END AS action, CASE WHEN n_regionkey = 1 THEN 'a \"' || n_name || '\"' ELSE 'c\\' || n_name END AS file FROM {nation}")
def s12_toml_plan(t):
    file = F.when(F.col("n_regionkey") == 1, F.concat(F.lit('a "'), "n_name", F.lit('"'))).otherwise(F.concat(F.lit("c\\"), "n_name"))
    steps = t.nation.select(F.col("n_nationkey").cast("int").alias("step"), F.when(F.col("n_regionkey") % 2 == 0, "copy").otherwise("rewrite").alias("action"), file.alias("file"))
    lines = K.plan_lines(t.spark.createDataFrame([("p",)], "id string"), steps, t.spark.createDataFrame([], "id string"))
    text = "\n".join(r.line for r in lines.orderBy("section", "place").collect())  # a plan is a small document
    return S.plan(t.spark, text, "steps").select(F.col("step").cast("int").alias("step"), "action", "file")


_described = lambda names, kind: _values(f"SELECT '{n}' AS name, column_name AS \"column\"{kind} FROM (DESCRIBE SELECT * FROM {{{n}}})" for n in names)


@query(_described(NAMES, ""))
def s14_schema_introspection(t):
    return S.columns_of({n: getattr(t, n) for n in NAMES}).select("name", "column")


TYPED = ("documents", "labels", "pages", "benchmark", "conversations")


@query(_described(TYPED, ", CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' END AS type"))
def s15_schema_types(t):
    return S.columns_of({n: getattr(t, n) for n in TYPED}).select("name", "column", "type")


def _sources(t):
    return t.registry.select(F.col("filepath").alias("path"), F.encode(F.concat(F.lit("// "), "status"), "UTF-8").alias("content"))


@query("SELECT filepath AS path, '// ' || status AS text FROM {registry} WHERE starts_with(filepath, 'src/src0/en/')")
def s16_store_files(t):
    return S.texts(_sources(t), "src/src0/en")


@query("SELECT doc_id, '/home' AS path FROM {registry} WHERE doc_id % 9 = 4 UNION ALL SELECT doc_id, '/r' || CAST(doc_id AS STRING) FROM {registry} WHERE doc_id % 9 = 4")
def s17_router_file(t):
    text = F.concat(F.lit("export default createRouter({ routes: [{ path: '/home', component: H }, { path: '/r"), F.col("doc_id").cast("string"), F.lit("' }] })"))
    tree = t.registry.select("doc_id", F.when(F.col("doc_id") % 9 == 4, "src/router/index.ts").otherwise("src/other.ts").alias("path"), text.alias("text"))
    return tree.where("path = 'src/router/index.ts'").select("doc_id", F.explode(J.routes(F.col("text"))).alias("r")).select("doc_id", "r.path")


@query("SELECT doc_id, 'load' AS command FROM {registry} WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, 'save_' || CAST(doc_id AS STRING) FROM {registry} WHERE doc_id % 3 = 1")
def s19_declared_commands(t):
    n = F.col("doc_id").cast("string")
    one = F.lit("#[tauri::command]\npub async fn load(x: u8) {}\nfn helper() {}\n")
    text = F.when(F.col("doc_id") % 3 == 0, one).when(F.col("doc_id") % 3 == 1, F.concat(one, F.lit("#[command(rename_all = \"snake_case\")]\npub(crate) fn save_"), n, F.lit("() {}"))).otherwise("fn load() {}")
    return t.registry.select("doc_id", F.explode(P.commands_declared(text)).alias("command"))


@query("SELECT filepath AS path FROM {registry} WHERE starts_with(filepath, 'src/src1/') OR starts_with(filepath, 'src/src2/de/')")
def s20_type_files(t):
    return S.texts(_sources(t), "src/src1", "src/src2/de/").select("path")


@query("SELECT 'missing' AS issue, 'owner' AS field UNION ALL SELECT 'extra', 'lang' UNION ALL SELECT 'extra', 'source' UNION ALL SELECT 'extra', 'n_chars' UNION ALL SELECT 'wrong type', 'text'")
def f29_shape(t):
    found = S.wrong_shape(t.documents, {"doc_id": "bigint", "text": "int", "owner": "string"})
    return t.spark.createDataFrame([(k, c) for k, cs in zip(("missing", "extra", "wrong type"), found) for c in cs], "issue string, field string")


# summaries and scalars


@query("SELECT 'src/' || dir || '/' || split_part(filepath, '/', 3) AS dir, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS largest, count(DISTINCT CASE WHEN doc_id % 50 = 1 THEN '.json' ELSE '.js' END) AS extensions, count(CASE WHEN doc_id % 50 = 1 THEN 1 END) AS configs FROM {registry} GROUP BY 1")
def n10_directory_summary(t):
    own = F.when(F.col("doc_id") % 50 == 1, F.concat(F.regexp_replace("filepath", "/[^/]*$", ""), F.lit("/package.json"))).otherwise(F.col("filepath"))
    return S.summary(t.registry.select(own.alias("path"), "bytes"))


@query("SELECT filepath AS path, 'dependencies' AS kind, 'vue' AS package, '^3.' || CAST(doc_id AS STRING) AS version FROM {registry} WHERE doc_id % 3 <> 0 UNION ALL SELECT filepath, 'devDependencies', 'vite', '*' FROM {registry} WHERE doc_id % 3 = 2 UNION ALL SELECT filepath, 'devDependencies', '@a/b', '1' FROM {registry} WHERE doc_id % 3 = 2")
def n10_dependencies(t):
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    dev = F.when(kind == 2, ', "devDependencies": {"vite": "*", "@a/b": "1"}').otherwise("")
    text = F.when(kind == 0, '{"name": "x"}').otherwise(F.concat(F.lit('{"dependencies": {"vue": "^3.'), n, F.lit('"}'), dev, F.lit("}")))
    return S.dependencies(t.registry.select(F.col("filepath").alias("path"), text.alias("text")))


RULES = "CASE doc_id % 9 WHEN 0 THEN 'UserTest' WHEN 1 THEN 'main' WHEN 2 THEN 'appSettings' WHEN 3 THEN 'string-utils' WHEN 4 THEN 'ORDER_SCHEMA' WHEN 5 THEN 'server' WHEN 6 THEN 'cartStore' WHEN 7 THEN 'parseRows' ELSE 'zebra' || CAST(doc_id AS STRING) END"


@query(f"SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Verifies behaviour' WHEN 1 THEN 'Entry point' WHEN 2 THEN 'Entry point' WHEN 3 THEN 'Shared helpers' WHEN 4 THEN 'Describes data' WHEN 5 THEN 'Serves requests' WHEN 6 THEN 'Keeps state' WHEN 7 THEN 'Parses text' ELSE 'Provides ' || {RULES} END AS purpose FROM {{registry}}")
def x17_purpose(t):
    return t.sql(f"SELECT doc_id, {RULES} || '.js' AS name FROM {{registry}}").select("doc_id", X.purpose(F.col("name")).alias("purpose"))


@query("SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS STRING) AS wrong FROM {supplier}")
def x30_sealed_keys(t):
    key = lambda c: F.lit(c * 32)
    sealed = t.supplier.select(F.col("s_suppkey").alias("id"), X.sealed(F.col("s_name"), key("k")).alias("x"))
    return sealed.select("id", X.opened(F.col("x"), key("k")).alias("name"), X.opened(F.col("x"), key("w")).alias("wrong"))


# sinks


@query("SELECT fingerprint, '{{\"bytes\":' || CAST(bytes AS STRING) || ',\"fingerprint\":\"' || fingerprint || '\",\"status\":\"' || status || '\"}}' AS line FROM {registry}")
def k04_card_lines(t):
    folder = _folder(t)
    K.write_cards(t.registry.select("status", "fingerprint", "bytes"), folder)
    return t.spark.read.text(folder).select(F.get_json_object("value", "$.fingerprint").alias("fingerprint"), F.col("value").alias("line"))


@query("SELECT fingerprint, status FROM {registry}")
def k01_manifest_file(t):
    folder = _folder(t)
    K.manifest(t.registry.select("fingerprint", "filepath", "status"), t.connections).select(F.col("json").alias("value")).write.text(folder)
    return t.spark.read.text(folder).select(F.get_json_object("value", "$.fingerprint").alias("fingerprint"), F.get_json_object("value", "$.status").alias("status"))


@query("SELECT replace(filepath, '/', '_') || '.txt' AS section, p.place, CASE p.place WHEN 0 THEN 'IDENTITY CARD ' || filepath WHEN 1 THEN '  filepath: ' || filepath WHEN 2 THEN '  status: ' || status ELSE '  quality: ' || coalesce(CAST(quality AS STRING), '-') END AS line FROM {registry} CROSS JOIN (SELECT 0 AS place UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p")
def k06_printed_cards(t):
    rows = t.registry.select("filepath", "status", "quality")
    others = t.spark.createDataFrame([("a/b.json", "RED", None), ("vendor/x.js", "RED", None), ("x/.archive/y.js", "RED", None)], rows.schema)
    return K.card_lines(rows.unionByName(others))


PLAN = """SELECT '0:' AS section, 0 AS place, '[metadata]' AS line UNION ALL SELECT '0:', 1, 'id = "plan"' UNION ALL SELECT '0:', 2, 'conflict_count = 3' UNION ALL SELECT '0:', 3, ''
UNION ALL SELECT '1:' || lpad(CAST(doc_id AS STRING), 12, '0'), p, CASE p WHEN 0 THEN '[[steps]]' WHEN 1 THEN 'step = ' || CAST(doc_id AS STRING) WHEN 2 THEN 'action = "copy"' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'file = "' || filename || '"' END ELSE '' END FROM {registry} CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) WHERE p < 4 OR doc_id % 2 = 1
UNION ALL SELECT '2:' || phase, p, CASE p WHEN 0 THEN '[[conflicts]]' WHEN 1 THEN 'id = "' || phase || '"' ELSE '' END FROM (SELECT DISTINCT phase FROM {registry}) CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2)"""


@query(PLAN)
def k10_plan_toml(t):
    steps = t.registry.select(F.col("doc_id").alias("step"), F.lit("copy").alias("action"), F.when(F.col("doc_id") % 2 == 1, F.col("filename")).alias("file"))
    return K.plan_lines(t.spark.createDataFrame([("plan", 3)], "id string, conflict_count int"), steps, t.registry.select(F.col("phase").alias("id")).distinct())


@query("SELECT phase AS section, 0 AS place, '## ' || phase AS line FROM {registry} GROUP BY phase UNION ALL SELECT phase, 1, CAST(count(*) AS STRING) || ' files, ' || CAST(count(CASE WHEN status = 'GREEN' THEN 1 END) AS STRING) || ' green' FROM {registry} GROUP BY phase UNION ALL SELECT phase || '/' || filepath, 0, '- ' || filepath || ' ' || status FROM {registry}")
def k11_phase_report(t):
    return K.phase_lines(t.registry)


@query("SELECT 'csv' AS form, CAST(n_nationkey AS STRING) AS section, CAST(n_nationkey AS STRING) || ',\"' || n_name || ', \"\"x\"\"\"' AS line FROM {nation} UNION ALL SELECT 'json', CAST(n_nationkey AS STRING), '{{\"id\":' || CAST(n_nationkey AS STRING) || ',\"name\":\"' || n_name || ', \\\"x\\\"\"}}' FROM {nation} UNION ALL SELECT 'sql', CAST(n_nationkey AS STRING), 'INSERT INTO nation (id, name) VALUES (' || CAST(n_nationkey AS STRING) || ', ''' || n_name || ', \"x\"'');' FROM {nation}")
def k12_exports(t):
    rows = t.nation.select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(', "x"')).alias("name"))
    parts = [K.dump_lines(rows, "nation", "id", form).select(F.lit(form).alias("form"), "section", "line") for form in ("csv", "json", "sql")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT filename AS store, 'state' AS prop, doc_id AS owner_id, false AS issue FROM {registry} WHERE doc_id % 2 = 0 UNION ALL SELECT filename, 'issue', CASE WHEN doc_id % 2 = 0 THEN doc_id END, true FROM {registry}")
def k16_rows_with_keys(t):
    owners = t.registry.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("filename").alias("name"))
    rows = lambda kind: t.registry.select(F.col("filename").alias("store"), F.lit(kind).alias("prop"))
    return K.with_keys(rows("state"), owners, "store", False).withColumn("issue", F.lit(False)).unionByName(K.with_keys(rows("issue"), owners, "store", True).withColumn("issue", F.lit(True)))


@query("""WITH r AS (SELECT phase AS id, count(CASE WHEN status = 'RED' THEN 1 END) AS bad, count(*) AS n FROM {registry} GROUP BY phase UNION ALL SELECT 'CLEAN', 0, 0)
SELECT '0' AS section, 0 AS place, '# Checks' AS line UNION ALL SELECT '0', 1, CAST(count(CASE WHEN bad = 0 THEN 1 END) AS STRING) || '/' || CAST(count(*) AS STRING) || ' checks pass' FROM r
UNION ALL SELECT '1:' || id, 0, '| ' || id || ' of phase | ' || CASE WHEN bad = 0 THEN 'ok' ELSE 'fail' END || ' | ' || CAST(n AS STRING) || ' files |' FROM r
UNION ALL SELECT '2:' || id, 0, '## ' || id FROM r WHERE bad > 0
UNION ALL SELECT '2:' || phase, CAST(k AS INT), '- ' || filepath FROM (SELECT phase, filepath, row_number() OVER (PARTITION BY phase ORDER BY filepath) AS k FROM {registry} WHERE status = 'RED') WHERE k <= 20
UNION ALL SELECT '2:' || id, 21, '- ... and ' || CAST(bad - 20 AS STRING) || ' more' FROM r WHERE bad > 20""")
def k17_check_report(t):
    checks = t.registry.groupBy(F.col("phase").alias("id")).agg(F.concat(F.count("*").cast("string"), F.lit(" files")).alias("message")).withColumn("title", F.lit("of phase"))
    clean = t.spark.createDataFrame([("CLEAN", "0 files", "of phase")], checks.schema)
    return K.check_lines(checks.unionByName(clean), t.registry.where("status = 'RED'").select(F.col("phase").alias("id"), F.col("filepath").alias("issue")))


@query("SELECT count(CASE WHEN status <> 'RED' THEN 1 END) AS ok, count(CASE WHEN status = 'RED' THEN 1 END) AS fail, '[{{\"error\":\"bad f\",\"n\":' || CAST(count(CASE WHEN status = 'RED' AND doc_id % 2 = 0 THEN 1 END) AS STRING) || '}},{{\"error\":\"no g\",\"n\":' || CAST(count(CASE WHEN status = 'RED' AND doc_id % 2 = 1 THEN 1 END) AS STRING) || '}}]' AS errors FROM {registry}")
def k18_error_summary(t):
    error = F.when(F.col("status") == "RED", F.when(F.col("doc_id") % 2 == 0, "bad f").otherwise("no g"))
    return K.error_summary(t.registry.select(F.col("filepath").alias("hook"), error.alias("error")))


@query("SELECT '{{\"path\":\"' || filepath || '\",\"origin\":\"mtime-fallback\"}}' AS json FROM {registry} WHERE doc_id % 3 = 2")
def k19_identity_risk(t):
    had = t.registry.where("doc_id % 3 = 0").select(F.col("filepath").alias("path"), "birth")
    stamp = lambda x: F.lit(x).cast("timestamp")
    seen = t.registry.select(F.col("filepath").alias("path"), F.when(F.col("doc_id") % 3 == 2, stamp("1970-01-01")).otherwise(stamp("2020-01-01")).alias("birthtime"), stamp("2024-01-01").alias("mtime"))
    return K.risk_records(S.identity(seen, had))


# snapshots


@query("SELECT source, target, kind FROM {connections} WHERE source_id % 2 = 0")
def m08_clear(t):
    rows = t.connections.select("source", "target", "kind", "source_id")
    return M.clear(rows).unionByName(rows.where("source_id % 2 = 0")).drop("source_id")


@query("SELECT fingerprint, phase, 'file' AS kind, CAST(NULL AS STRING) AS actor FROM {registry} UNION ALL SELECT 'plan/' || dir || '.js||2026-03-01', 'CONCEPT', 'file', NULL FROM {registry} GROUP BY dir UNION ALL SELECT 'plan/' || dir || '.js||2026-03-01', NULL, 'CONCEPT', CASE WHEN dir = 'src0' THEN 'AI' ELSE 'DEVELOPER' END FROM {registry} GROUP BY dir")
def m11_register_concepts(t):
    entries = t.registry.select(F.concat(F.lit("plan/"), "dir", F.lit(".js")).alias("filepath"), F.when(F.col("dir") == "src0", "AI").alias("actor")).distinct()
    files, log = M.register_concepts(t.registry, entries, "2026-03-01")
    return files.select("fingerprint", "phase", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("actor")).unionByName(log.select("fingerprint", F.lit(None).cast("string").alias("phase"), "kind", "actor"))


@query("SELECT file_id, count(*) + count(CASE WHEN severity = 'error' THEN 1 END) + CASE WHEN file_id = 'f1' THEN 5 ELSE 0 END AS total, greatest(max(pass_number), CASE WHEN file_id = 'f1' THEN 9 ELSE 0 END) AS last_pass FROM {insights} GROUP BY file_id UNION ALL SELECT 'other', 2, 1")
def m21_insight_slots(t):
    old = t.spark.createDataFrame([("f1", 5, 9, None), ("other", 2, 1, None)], "file_id string, total long, last_pass long, last_ts timestamp")
    rows = t.insights.select("file_id", "pass_number", F.col("ts").cast("timestamp").alias("ts"), "severity")
    return M.slots(M.slots(old, rows.drop("severity")), rows.where("severity = 'error'").drop("severity")).select("file_id", "total", "last_pass")


@query("SELECT 'project' AS kind, dir AS name, CASE WHEN dir = 'src1' THEN 'new' ELSE 'old' END AS state FROM {registry} WHERE dir <> 'src2' GROUP BY dir UNION ALL SELECT 'file', filepath, dir FROM {registry} WHERE dir <> 'src2'")
def m26_projects(t):
    projects = t.registry.select("dir", F.lit("old").alias("state")).distinct()
    projects = M.upsert(projects, t.spark.createDataFrame([("src1", "new")], "dir string, state string"), ["dir"])
    left = M.cascade({"projects": projects, "files": t.registry.select("filepath", "dir")}, t.spark.createDataFrame([("src2",)], "dir string"), {"projects": ["dir"], "files": ["dir"]})
    return left["projects"].select(F.lit("project").alias("kind"), F.col("dir").alias("name"), "state").unionByName(left["files"].select(F.lit("file").alias("kind"), F.col("filepath").alias("name"), F.col("dir").alias("state")))


@query("SELECT filepath, CASE WHEN status = 'RED' THEN 'moved' ELSE phase END AS phase, 'ValueError: no' AS error FROM {registry}")
def m27_atomic_change(t):
    root = _folder(t)
    M.publish(t.spark, root, {"files": t.registry.select("filepath", "status", "phase")}, 1)
    first = M.atomically(t.spark, root, ["files"], lambda x: {"files": M.update(x["files"], F.col("status") == "RED", phase="moved")}, 2)

    def fails(tables):
        M.publish(t.spark, root + "-elsewhere", tables, 1)  # what it did on the way is not seen
        raise ValueError("no")

    error = first or M.atomically(t.spark, root, ["files"], fails, 3)
    return M.current(t.spark, root, "files").select("filepath", "phase", F.lit(error).alias("error"))


# search


def _indexed(df, text, collection="files"):
    return H.build_index(df.select(F.col("filepath").alias("object"), text.alias("text")), "object", "text", collection)


@query("SELECT filepath AS object, lower(status) AS term FROM {registry} UNION ALL SELECT filepath, 'other' FROM {registry} WHERE doc_id = 1")
def h05_reindex(t):
    old = _indexed(t.registry, F.col("phase")).unionByName(_indexed(t.registry.where("doc_id = 1"), F.lit("other"), "notes"))
    return H.reindex(old, _indexed(t.registry, F.col("status")), "files").select("object", "term")


@query("SELECT filepath AS object, lower(CASE WHEN doc_id % 3 = 1 THEN status ELSE phase END) AS term FROM {registry} WHERE doc_id % 3 <> 0 UNION ALL SELECT 'new.js', 'fresh'")
def h06_incremental_index(t):
    had = t.registry.select(F.col("filepath").alias("object"), F.lit("1").alias("sha"), F.col("phase").alias("text"))
    changed = F.col("doc_id") % 3 == 1
    have = t.registry.where("doc_id % 3 <> 0").select(F.col("filepath").alias("object"), F.when(changed, "2").otherwise("1").alias("sha"), F.when(changed, F.col("status")).otherwise("never read").alias("text"))
    have = have.unionByName(t.spark.createDataFrame([("new.js", "1", "Fresh")], "object string, sha string, text string"))
    return H.incremental(_indexed(t.registry, F.col("phase")), had, have, "files").select("object", "term")


@query("SELECT 'p1:' || CAST(node_id AS STRING) AS object FROM {nodes} WHERE node_type = 'route'")
def h08_enrichment(t):
    named = H.enrichment(t.nodes, "p1")
    return H.search(H.build_index(named, "object", "text", "nodes"), ["route"]).select("object")


# streams


@query("SELECT fingerprint AS path, lower(kind) AS type, count(*) AS n FROM {mutations} GROUP BY 1, 2")
def t01_event_stream(t):
    source, out = _folder(t), _folder(t)
    t.mutations.select(F.col("fingerprint").alias("path"), F.lower("kind").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.lit("x").alias("sha")).write.json(source)
    stream = C.events(t.spark, source).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return t.spark.read.parquet(out).groupBy("path", "type").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT id, kind, ts, max(ts) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {mutations}),
 b AS (SELECT kind, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 600 SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT count(DISTINCT burst) AS bursts, count(DISTINCT (burst, kind)) AS kinds FROM b""")
def t02_flushes(t):
    changes = t.mutations.select(F.lit("all").alias("path"), F.lower("kind").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    return C.flushes(changes, "600 seconds").agg(F.count_distinct("start").alias("bursts"), F.count("*").alias("kinds"))


@query("SELECT fingerprint AS path, CASE WHEN CAST(substr(fingerprint, 2) AS BIGINT) % 3 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS kind FROM (SELECT DISTINCT fingerprint FROM {mutations}) WHERE CAST(substr(fingerprint, 2) AS BIGINT) % 3 < 2")
def t04_changed_only(t):
    known = t.mutations.select(F.col("fingerprint").alias("path"), F.lit("same").alias("sha")).distinct()
    third = F.substring("fingerprint", 2, 20).cast("long") % 3
    batch = t.mutations.select(F.col("fingerprint").alias("path"), F.when(third == 0, "unlink").otherwise("change").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.when(third == 1, "other").otherwise("same").alias("sha"))
    return C.if_changed(C.apply_batch(known, batch)[1], lambda made: made)


@query("SELECT fingerprint AS path, 'UPDATE' AS kind FROM {mutations} WHERE false")
def t04_nothing_changed(t):
    known = t.mutations.select(F.col("fingerprint").alias("path"), F.lit("same").alias("sha")).distinct()
    batch = t.mutations.select(F.col("fingerprint").alias("path"), F.lit("change").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.lit("same").alias("sha"))

    def never(made):
        raise RuntimeError("nothing changed")

    return C.if_changed(C.apply_batch(known, batch)[1], never)


@query("SELECT 'late,early,failed,last' AS ran, 3 AS ok, 1 AS fail, 'ValueError: no' AS errors")
def t07_hook_chain(t):
    hooks, ran = C.Hooks(), []

    def failing(rows):
        ran.append("failed")
        raise ValueError("no")

    hooks.register("done", lambda rows: ran.append("last"), 90)
    hooks.register("done", failing, 50)
    hooks.register("done", lambda rows: ran.append("late"), 10)
    hooks.register("done", lambda rows: ran.append("early"), 10)
    hooks.register("other", lambda rows: ran.append("not"), 1)
    found = hooks.run("done", t.registry)
    return t.spark.createDataFrame([(",".join(ran), found["ok"], found["fail"], ",".join(found["errors"]))], "ran string, ok int, fail int, errors string")


@query("SELECT id, CAST(row_number() OVER (ORDER BY bytes DESC, id) - 1 AS BIGINT) AS position, CAST(floor((row_number() OVER (ORDER BY bytes DESC, id) - 1) / 2) AS BIGINT) AS wave FROM (SELECT doc_id AS id, bytes FROM {registry})")
def t09_job_queue(t):
    return C.scheduled(t.registry.select(F.col("doc_id").alias("id"), F.col("bytes").alias("priority"))).select("id", "position", "wave")


@query("SELECT doc_id, doc_id % 3 <> 1 AS due FROM {registry}")
def t10_daily_gate(t):
    stamp = lambda x: F.lit(x).cast("timestamp")
    last = F.when(F.col("doc_id") % 3 == 0, stamp("2026-01-01 10:00:00")).when(F.col("doc_id") % 3 == 1, stamp("2026-01-01 10:00:01"))
    return t.registry.select("doc_id", C.due(last, stamp("2026-01-02 10:00:00")).alias("due"))


@query("SELECT fingerprint AS path, count(CASE WHEN last IS NULL OR ts > last THEN 1 END) AS since FROM (SELECT fingerprint, ts, max(CASE WHEN kind = 'PURCHASE' THEN ts END) OVER (PARTITION BY fingerprint) AS last FROM {mutations}) GROUP BY fingerprint")
def t12_session_counters(t):
    return C.session_counts(t.mutations.select(F.col("fingerprint").alias("path"), F.col("ts").alias("at"), (F.col("kind") == "PURCHASE").alias("touched")))


# caches, further reports and sinks


@query("SELECT node_id FROM {nodes} WHERE graph_id = 'g2'")
def s11_cached_graph(t):
    cache = Q.GraphCache(t.nodes, t.edges, size=1)
    cache.get("g1")
    found = cache.get("g2")[0].select("node_id")
    assert list(cache.held) == ["g2"]
    return found


@query("SELECT filepath, phase, CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE 'true' END AS changed FROM {registry} WHERE doc_id % 2 = 1 UNION ALL SELECT filepath, 'later', 'true' FROM {registry} WHERE doc_id % 2 = 0")
def s13_versioned_read(t):
    root = _folder(t)
    M.publish(t.spark, root, {"files": t.registry.select("filepath", "phase")}, 1)
    reader = Q.VersionedRead(t.spark, root, "files", M.current)
    looks = [reader.get()[1], reader.get()[1]]
    M.publish(t.spark, root, {"files": M.update(t.registry, F.col("doc_id") % 2 == 0, phase="later").select("filepath", "phase")}, 2)
    df, changed = reader.get()
    return df.withColumn("changed", F.lit(str(changed and looks == [True, False]).lower()))


@query("SELECT client, message FROM (SELECT 'c' || CAST(n AS STRING) AS client FROM (SELECT unnest(range(10)) AS n)) CROSS JOIN (SELECT 'RED' AS message UNION ALL SELECT ':heartbeat')")
def t06_feed(t):
    feed = Q.Feed()
    assert [feed.join(f"c{i}", 0.0) for i in range(11)] == [True] * 10 + [False]
    feed.publish(t.registry.where("status = 'RED'").select("status").first()[0], 1.0)
    feed.tick(20.0)  # heard not long ago
    feed.tick(31.0)
    return t.spark.createDataFrame([(c, m) for c, q in feed.clients.items() for m in q], "client string, message string")


@query("SELECT 2 AS version, true AS changed")
def t11_change_notice(t):
    root = _folder(t)
    M.publish(t.spark, root, {"files": t.registry.select("filepath")}, 1)
    reader = Q.VersionedRead(t.spark, root, "files", M.current)
    reader.get()
    M.publish(t.spark, root, {"files": t.registry.select("filepath")}, 2)
    _, changed = reader.get()
    return t.spark.createDataFrame([(reader.version, changed and not reader.get()[1])], "version int, changed boolean")


@query("SELECT node_type, count(*) AS n, went FROM (SELECT DISTINCT dir, 'command' AS node_type, phase AS name, 'retried' AS went FROM {registry} UNION ALL SELECT dir, 'store', filename, 'parsed' FROM {registry} UNION ALL SELECT dir, 'route', 'unread', 'fallback' FROM {registry} GROUP BY dir) GROUP BY node_type, went")
def u05_resilient_ingestion(t):
    def report(line, kind):
        return t.registry.select(F.col("dir").alias("project"), line.alias("text"), F.lit(kind).alias("kind"))

    reports = report(F.concat(F.lit("Command: "), "phase"), "command").unionByName(report(F.concat(F.lit("--- Store ID: "), "filename", F.lit(" ---")), "store")).unionByName(report(F.lit("x"), "route"))
    tries = []

    def second_time(rows):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("not yet")
        return P.report_nodes(rows, "command")

    def broken(rows):
        raise ValueError("never")

    plain = lambda rows, kind: rows.select("project", F.lit(kind).alias("node_type"), F.lit("unread").alias("name"), F.lit(None).cast("string").alias("path")).distinct()
    nodes, went = P.ingest_with(reports, {"command": second_time, "store": lambda rows: P.report_nodes(rows, "store"), "route": broken}, plain)
    said = F.create_map(*(F.lit(x) for kv in went.items() for x in kv))
    return nodes.groupBy("node_type").agg(F.count("*").alias("n")).withColumn("went", F.element_at(said, F.col("node_type")))


@query("""SELECT 'a' AS section, 0 AS place, '## Largest' AS line UNION ALL SELECT 'a', CAST(k AS INT), '- ' || filepath FROM (SELECT filepath, row_number() OVER (ORDER BY bytes DESC, filepath) AS k FROM {registry}) WHERE k <= 20 UNION ALL SELECT 'a', 21, '... and ' || CAST(count(*) - 20 AS STRING) || ' more' FROM {registry}
UNION ALL SELECT 'b', 0, '## Few' UNION ALL SELECT 'b', CAST(row_number() OVER (ORDER BY n_name) AS INT), '- ' || n_name FROM {nation} WHERE n_nationkey < 3""")
def k08_gap_report(t):
    a = K.top_lines(t.registry, "a", "Largest", F.col("filepath"), [-F.col("bytes"), F.col("filepath")], 20)
    return a.unionByName(K.top_lines(t.nation.where("n_nationkey < 3"), "b", "Few", F.col("n_name"), [F.col("n_name")], 15))


@query("SELECT '0' AS section, 0 AS place, '# Migration report' AS line UNION ALL SELECT '0', 1, '- outcome: PARTIAL' UNION ALL SELECT '0', 2, '- reachability: 0.75' UNION ALL SELECT '1:' || status, 0, '- ' || status || ': ' || CAST(count(*) AS STRING) FROM {registry} GROUP BY status UNION ALL SELECT '2:' || lpad(CAST(doc_id AS STRING), 12, '0'), 0, CAST(doc_id AS STRING) || '. copy: ' || filename FROM {registry}")
def k09_migration_report(t):
    steps = t.registry.select(F.col("doc_id").alias("step"), F.lit("copy").alias("action"), F.col("filename").alias("description"))
    return K.migration_lines(t.spark.createDataFrame([("PARTIAL", 0.75)], "outcome string, reachability double"), steps, t.registry.select(F.col("doc_id").alias("id"), F.col("status").alias("conflict")))


@query("SELECT node_id AS id, node_type AS kind, name, path, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst FROM {nodes} WHERE graph_id = 'g2' UNION ALL SELECT edge_id, edge_type, status, NULL, src, dst FROM {edges} WHERE graph_id = 'g2'")
def k14_saved_graph(t):
    root = _folder(t)
    M.publish(t.spark, root, {"nodes": t.nodes, "edges": t.edges}, 1)
    nodes, edges = (M.current(t.spark, root, n).where("graph_id = 'g2'") for n in ("nodes", "edges"))
    none = F.lit(None).cast("long")
    return nodes.select(F.col("node_id").alias("id"), F.col("node_type").alias("kind"), "name", "path", none.alias("src"), none.alias("dst")).unionByName(
        edges.select(F.col("edge_id").alias("id"), F.col("edge_type").alias("kind"), F.col("status").alias("name"), F.lit(None).cast("string").alias("path"), "src", "dst")
    )


@query("SELECT node_type, name FROM (SELECT DISTINCT dir, 'command' AS node_type, phase AS name FROM {registry} UNION ALL SELECT dir, 'store', filename FROM {registry})")
def k15_parser_snapshot(t):
    def report(line, kind):
        return t.registry.select(F.col("dir").alias("project"), line.alias("text"), F.lit(kind).alias("kind"))

    root = _folder(t)
    reports = report(F.concat(F.lit("Command: "), "phase"), "command").unionByName(report(F.concat(F.lit("--- Store ID: "), "filename", F.lit(" ---")), "store"))
    M.publish(t.spark, root, {"nodes": P.ingest(reports)}, 1)
    return M.current(t.spark, root, "nodes").select("node_type", "name")


@query("SELECT doc_id AS step, CASE WHEN doc_id % 2 = 0 THEN 'rewrite' ELSE 'copy' END AS action FROM {registry}")
def m23_replaced_plan(t):
    root = _folder(t)
    M.publish(t.spark, root, {"plan": t.registry.select(F.col("doc_id").alias("step"), F.lit("copy").alias("action"))}, 1)
    M.publish(t.spark, root, {"plan": M.update(M.current(t.spark, root, "plan"), F.col("step") % 2 == 0, action="rewrite")}, 2)
    return M.current(t.spark, root, "plan")


@query("SELECT doc_id, CASE WHEN status = 'RED' THEN 'main' || CAST(doc_id AS STRING) ELSE 'f' || CAST(doc_id AS STRING) || ',h' END AS names FROM {registry}")
def x29_export_names(t):
    rows = P.exports(t.code.withColumn("path", F.col("doc_id").cast("string")))
    return rows.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("SELECT event_type AS hook, count(*) AS runs, count(CASE WHEN value >= 20 THEN 1 END) AS failed FROM {events} GROUP BY event_type")
def a30_hook_summary(t):
    runs = t.events.select(F.col("event_type").alias("hook"), F.when(F.col("value") >= 20, "slow").alias("error"))
    return runs.groupBy("hook").agg(F.count("*").alias("runs"), F.count("error").alias("failed"))


def _tree(t, *directories):
    """A folder with the registry's file names as lines of text files, each k-th row in the k-th of the directories."""
    root = _folder(t)
    for k, directory in enumerate(directories):
        t.registry.where(F.col("doc_id") % len(directories) == k).select("filename").write.text(f"{root}/{directory}")
    return root


def _lines_of(found):
    """dir, line of scanned text files."""
    return S.texts(found).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@query("SELECT CASE doc_id % 6 WHEN 0 THEN 'src/a' ELSE 'src/deep/b' END AS dir, filename AS line FROM {registry} WHERE doc_id % 6 < 2")
def s22_protected_walk(t):
    root = _tree(t, "src/a", "src/deep/b", "node_modules/c", "src/.git/d", "x/vendor/y/e", "locked/f")
    return _lines_of(S.scan(t.spark, root, extensions=(".txt",), ignored=(*S.IGNORED, "locked")))


@query("SELECT CASE doc_id % 4 WHEN 1 THEN 'src/b' ELSE 'src-native/c' END AS dir, filename AS line FROM {registry} WHERE doc_id % 4 IN (1, 2)")
def s04_project_files(t):
    found = S.scan(t.spark, _tree(t, "docs/a", "src/b", "src-native/c", "src-other/d"), extensions=(".txt",))
    paths = S.texts(found, "src", "src-native").select("path").orderBy("path")
    return _lines_of(found.join(paths, "path", "left_semi"))


@query("SELECT dir, sha256(string_agg(filename || chr(10), '' ORDER BY filename)) AS sha, CAST(sum(length(filename) + 1) AS BIGINT) AS bytes FROM {registry} GROUP BY dir")
def s02_file_hash(t):
    root = _folder(t)
    t.registry.select("dir", "filename").repartition("dir").sortWithinPartitions("dir", "filename").write.partitionBy("dir").text(root)
    return S.scan(t.spark, root, extensions=(".txt",)).select(F.regexp_extract("path", "dir=([^/]*)/", 1).alias("dir"), F.col("sha256").alias("sha"), F.col("bytes").cast("long").alias("bytes"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'n-button,n-icon' ELSE 'u-card' END AS tags FROM {registry}")
def u06_tag_option(t):
    text = F.lit("<n-button><u-card/><n-icon/></n-button><n-button/>")
    tags = F.when(F.col("doc_id") % 2 == 0, P.ui_tags(text)).otherwise(P.ui_tags(text, "<(u-[a-z]+)"))
    return t.registry.select("doc_id", F.array_join(F.array_sort(tags), ",").alias("tags"))
