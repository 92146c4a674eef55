"""Queries of reports with their fields and edges (N): a report of each kind for every file of the registry, its project being the directory."""

from pyspark.sql import functions as F

from lodestone.functions import intent_rules as I
from lodestone.functions import reports as R
from lodestone.registry import query

def _id():
    return F.col("doc_id").cast("string")


def _lines(*parts):
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _of(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _texts(t):
    """kind -> text, by file."""
    path, name = F.col("filepath"), F.col("filename")
    odd = F.col("doc_id") % 2 == 1
    return {
        "file": _lines("Overview", _of(_id(), ": ", path), "[2] none", _of("  7: [COMPARE] ", path)),
        "store": _lines(_of("--- Store ID: s", _id(), " ---"), _of("File: ", F.when(odd, path).otherwise("elsewhere.ts")), _of("Exported As: useS", _id()), "Type: Options Object", _of("  State Properties (2): k", _id(), ", own"), "  Getters (0): None", F.when(odd, "  Actions (1): go"), "===", "Exported As: stray"),
        "route": _lines(_of("- Path: /r", _id()), F.when(odd, _of("    Name: route", _id())), _of("    Component: ", F.when(F.col("doc_id") % 3 == 0, "(Dynamic Import)").otherwise(_of("V", _id()))), _of("  - Path: /r", _id(), "/child"), F.rpad(F.lit("    note: "), 260, "x"), "    Component: TooFar"),
        "command": _lines(_of("Command: c", _id()), "  Invoked in: 2 file(s)", _of("    - ", path), "    - gone.vue", F.when(odd, _of("  Declared in: src/", _id(), ".rs")), "---", "    - stray.vue"),
        "type": _lines(_of("--- File: ", path, " ---"), _of("export interface T", _id(), " { type: string }"), _of("type U", _id(), " = enum lower; enum E", _id(), " {}"), "===", "interface Stray {}"),
        "component": _lines(_of("File Name: V", _id(), ".vue (", path, ")"), F.when(odd, _of("  UI Elements (2): n-button, n-", _id()))),
    }


def _reports(t, *kinds):
    texts = _texts(t)
    return t.registry.select(F.col("dir").alias("project"), "doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), texts[k].alias("text")) for k in kinds))).alias("x")).select("project", "doc_id", "x.kind", "x.text")


def _fields(df, *names):
    return df.select("project", "name", "path", *(F.array_join(F.col("fields")[n], ",").alias(n) for n in names))


@query("""SELECT dir AS project, 's' || CAST(doc_id AS STRING) AS name, CASE WHEN doc_id % 2 = 1 THEN filepath ELSE 'elsewhere.ts' END AS path, 'useS' || CAST(doc_id AS STRING) AS exportedAs, 'Options Object' AS storeType,
 'k' || CAST(doc_id AS STRING) || ',own' AS stateKeys, '' AS getterKeys, CASE WHEN doc_id % 2 = 1 THEN 'go' END AS actionKeys FROM {registry}""")
def n02_store_fields(t):
    return _fields(R.entries(_reports(t, "store"), "doc_id"), "exportedAs", "storeType", "stateKeys", "getterKeys", "actionKeys")


@query("""SELECT dir AS project, CASE WHEN doc_id % 2 = 1 THEN 'route' || CAST(doc_id AS STRING) ELSE '/r' || CAST(doc_id AS STRING) END AS name, '/r' || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 3 = 0 THEN '(Dynamic Import)' ELSE 'V' || CAST(doc_id AS STRING) END AS component FROM {registry}
UNION ALL SELECT dir, '/r' || CAST(doc_id AS STRING) || '/child', '/r' || CAST(doc_id AS STRING) || '/child', NULL FROM {registry}""")
def n03_route_fields(t):
    return _fields(R.entries(_reports(t, "route"), "doc_id"), "component")


@query("""SELECT dir AS project, 'c' || CAST(doc_id AS STRING) AS name, CASE WHEN doc_id % 2 = 1 THEN 'src/' || CAST(doc_id AS STRING) || '.rs' END AS path, '2 file(s)' AS invokedIn, CASE WHEN doc_id % 2 = 1 THEN 'src/' || CAST(doc_id AS STRING) || '.rs' END AS declaredIn, filepath || ',gone.vue' AS invokedFiles FROM {registry}""")
def n04_command_fields(t):
    return _fields(R.entries(_reports(t, "command"), "doc_id"), "invokedIn", "declaredIn", "invokedFiles")


@query("SELECT dir AS project, k.k || CAST(doc_id AS STRING) AS name, filepath AS path FROM {registry}, (VALUES ('T'), ('U'), ('E')) k(k)")
def n05_types_in_blocks(t):
    return _fields(R.entries(_reports(t, "type"), "doc_id"))


@query("SELECT dir AS project, 'V' || CAST(doc_id AS STRING) || '.vue' AS name, filepath AS path, CASE WHEN doc_id % 2 = 1 THEN 'n-button,n-' || CAST(doc_id AS STRING) END AS uiElements FROM {registry}")
def n06_component_elements(t):
    return _fields(R.entries(_reports(t, "component"), "doc_id"), "uiElements")


KINDS = ("file", "store", "route", "command", "type", "component")


@query("""WITH r AS (SELECT dir AS project, doc_id, filepath, CAST(doc_id AS STRING) AS i FROM {registry})
SELECT project, 'file' AS source_type, filepath AS source, 'store' AS target_type, 's' || i AS target, 'contains' AS edge_type, 1.0::DOUBLE AS confidence FROM r WHERE doc_id % 2 = 1
UNION ALL SELECT project, 'file', filepath, 'type', k.k || i, 'contains', 1.0 FROM r, (VALUES ('T'), ('U'), ('E')) k(k)
UNION ALL SELECT project, 'file', filepath, 'component', 'V' || i || '.vue', 'contains', 1.0 FROM r
UNION ALL SELECT project, 'route', CASE WHEN doc_id % 2 = 1 THEN 'route' || i ELSE '/r' || i END, 'component', 'V' || i || '.vue', 'navigates_to', 0.9 FROM r WHERE doc_id % 3 <> 0
UNION ALL SELECT project, 'file', filepath, 'command', 'c' || i, 'invokes', 0.95 FROM r""")
def n08_report_edges(t):
    e = R.report_edges(R.entries(_reports(t, *KINDS), "doc_id"))
    return e.select("project", F.col("source.node_type").alias("source_type"), F.col("source.name").alias("source"), F.col("target.node_type").alias("target_type"), F.col("target.name").alias("target"), "edge_type", "confidence")


@query("""WITH c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'external' ELSE 'current' END AS project, doc_id, path, status, CAST(doc_id AS STRING) AS i FROM {code}),
 w AS (SELECT project, 'f' || CAST(doc_id + 1 AS STRING) AS name, count(*) AS n FROM c GROUP BY ALL)
SELECT project, 'import' AS node_type, './f' || CAST(doc_id + 1 AS STRING) AS name, 'named' AS kind, path AS file, NULL AS weight FROM c
UNION ALL SELECT project, 'import', 'pkg' || CAST(doc_id % 9 AS STRING), 'require', min(path), NULL FROM c GROUP BY project, doc_id % 9
UNION ALL SELECT c.project, 'export', 'f' || i, 'declaration', path, coalesce(w.n, 0) FROM c LEFT JOIN w ON w.project = c.project AND w.name = 'f' || i WHERE status <> 'RED'
UNION ALL SELECT project, 'export', 'h', 'commonjs', min(path), 0 FROM c WHERE status <> 'RED' GROUP BY project
UNION ALL SELECT project, 'export', 'main' || i, 'default', path, 0 FROM c WHERE status = 'RED'""")
def n09_two_projects(t):
    files = t.code.select(F.when(F.col("doc_id") % 3 == 0, "external").otherwise("current").alias("project"), "path", "text")
    found = R.source_nodes(files)
    one = lambda *names: F.coalesce(*(F.get(F.col("fields")[n], F.lit(0)) for n in names))
    return found.select("project", "node_type", "name", one("importType", "kind").alias("kind"), F.coalesce(one("sourceFile"), "path").alias("file"), one("dependencyWeight").cast("long").alias("weight"))


def _quoted(x):
    return "'" + x.replace("'", "''") + "'"


def _first(name, rules, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches({name}, {_quoted(p)}, 'i') THEN {_quoted(v)}" for p, v in rules) + f" ELSE {otherwise} END"


#: A name for each rule, in turn, with the rule's own word in it: in capitals, with a mark, or as part of a longer word.
_WORDS = [I.spelled(p)[-1] for p, _ in I.PURPOSES]
NAMED = f"CASE doc_id % {len(_WORDS) + 2} " + " ".join(f"WHEN {k} THEN {_quoted(('x' if k % 3 == 1 else '') + (w.upper() if k % 3 == 2 else w) + ('' if e or k % 3 else 'xs'))}" for k, (w, e) in enumerate(_WORDS)) + f" WHEN {len(_WORDS)} THEN 'types_of_z' ELSE 'qqq' END"


@query(f"""WITH n AS (SELECT doc_id, {NAMED} AS name FROM {{registry}}) SELECT doc_id, name, {_first('name', I.PURPOSES, 'NULL')} AS purpose FROM n""")
def w06_rules_of_names(t):
    names = t.sql(f"SELECT doc_id, {NAMED} AS name FROM {{registry}}")
    return names.join(I.first_rule(names, I.rule_table(t.spark, I.PURPOSES)), "name", "left").select("doc_id", "name", F.col("output").alias("purpose"))


IMPORTED = "CASE doc_id % 5 WHEN 0 THEN 'node:fs' WHEN 1 THEN './Graph_builder.js' WHEN 2 THEN '../left/pad.ts' WHEN 3 THEN 'Express' END"
EXPORTED = "CASE doc_id % 7 WHEN 0 THEN 'startServer' WHEN 1 THEN 'allTypes' WHEN 2 THEN 'Other' WHEN 3 THEN 'IndexPrinter' END"


@query(f"""WITH f AS (SELECT doc_id, 'src/' || CASE WHEN doc_id % 4 = 0 THEN 'cli-' || CAST(doc_id AS STRING) WHEN doc_id % 4 = 1 THEN 'watcher' || CAST(doc_id AS STRING) ELSE 'm' || CAST(doc_id AS STRING) END || '.js' AS path, {IMPORTED} AS one, {EXPORTED} AS given, doc_id % 6 = 0 AS noted FROM {{registry}}),
 r AS (SELECT path, one, given, CASE WHEN doc_id % 4 = 0 THEN 'Command-line interface' WHEN doc_id % 4 = 1 THEN 'File system change monitoring' END AS named, CASE WHEN noted THEN 'Keeps what was seen' END AS note,
  {_first('one', I.BEHAVIOURS, 'NULL')} AS uses, {_first('given', I.VALUES, 'NULL')} AS gives FROM f)
SELECT path, coalesce(nullif(concat_ws(' — ', named, note), ''), 'Uses ' || uses, 'Provides ' || gives, 'Source module at ' || path) || ' ???' AS purpose,
 CASE WHEN one IS NULL THEN 'No external dependencies' ELSE coalesce(uses, 'pad') || ', os' END || ' ???' AS depends_on,
 coalesce('Provides ' || coalesce(gives, given || ' API'), CASE WHEN contains(path, 'cli') THEN 'Command-line interface for project operations' ELSE 'Internal module with no public exports' END) || ' ???' AS value FROM r""")
def x17_intents(t):
    rows = t.sql(f"SELECT 'src/' || CASE WHEN doc_id % 4 = 0 THEN 'cli-' || CAST(doc_id AS STRING) WHEN doc_id % 4 = 1 THEN 'watcher' || CAST(doc_id AS STRING) ELSE 'm' || CAST(doc_id AS STRING) END || '.js' AS path, {IMPORTED} AS one, {EXPORTED} AS given, doc_id % 6 = 0 AS noted FROM {{registry}}")
    first = rows.where("one IS NOT NULL").select("path", F.lit(0).alias("ordinal"), F.col("one").alias("specifier"))
    took = first.unionByName(first.select("path", F.lit(1).alias("ordinal"), F.lit("os").alias("specifier"))).unionByName(first.withColumn("ordinal", F.lit(2)))
    gave = rows.where("given IS NOT NULL").select("path", F.lit(0).alias("ordinal"), F.col("given").alias("name"))
    notes = rows.select("path", F.when(F.col("noted"), "Keeps what was seen").otherwise("short").alias("comment"))
    return I.intents(rows, took, gave, notes)
