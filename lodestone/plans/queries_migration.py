"""Queries of migration operators (X, O, F, G, U, N), on rows in which every branch occurs."""

from pyspark.sql import functions as F

from lodestone.functions import literals as J
from lodestone.functions import source_text as P
from lodestone.operators import graph as G
from lodestone.operators import migration as I
from lodestone.registry import query

CYCLIC = "WITH RECURSIVE walk AS (SELECT src AS a, dst AS b FROM {mod_edges} UNION SELECT w.a, e.dst FROM walk w JOIN {mod_edges} e ON e.src = w.b), cyc AS (SELECT DISTINCT a AS node_id FROM walk WHERE a = b), dead AS (SELECT node_id, name FROM {mods} WHERE node_type = 'import' AND node_id NOT IN (SELECT src FROM {mod_edges}))"


def _case(t, *values, by="doc_id"):
    """The value of a row, dealt out in turn by its id."""
    i = F.pmod(F.col(by), F.lit(len(values)))
    return F.get(F.array(*(v if not isinstance(v, (str, bool, type(None))) else F.lit(v) for v in values)), i.cast("int"))


@query(CYCLIC + """, deg AS (SELECT n.node_id, n.node_type, n.name, (SELECT count(*) FROM {mod_edges} e WHERE e.dst = n.node_id AND e.src <> e.dst) AS i, (SELECT count(*) FROM {mod_edges} e WHERE e.src = n.node_id AND e.src <> e.dst) AS o FROM {mods} n)
SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM cyc) THEN 'broken' WHEN node_type = 'import' AND name IN (SELECT name FROM dead) THEN 'broken'
  WHEN node_type = 'file' AND i = 0 AND o = 0 THEN 'unused' WHEN node_type <> 'file' AND i = 0 THEN 'partial' ELSE 'healthy' END AS health FROM deg""")
def g16_module_health(t):
    return G.health(t.mods, t.mod_edges, G.on_cycles(t.mod_edges.select("src", "dst"))).select("node_id", "health")


@query(CYCLIC + " SELECT node_id, name FROM dead")
def g17_dead_imports(t):
    return G.dead_imports(t.mods, t.mod_edges)


@query("SELECT CAST(a.src AS STRING) || ',' || CAST(a.dst AS STRING) AS members FROM {mod_edges} a JOIN {mod_edges} b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT CAST(src AS STRING) FROM {mod_edges} WHERE src = dst")
def g10_back_edge_cycles(t):
    return G.back_edge_cycles(t.mod_edges.select("src", "dst")).select(F.array_join(F.transform(F.array_sort("cycle"), lambda x: x.cast("string")), ",").alias("members"))


# dependencies are one step deep here: a file follows what it needs, at its own name's turn or, if that has passed, at once
@query("""WITH e AS (SELECT src, dst FROM {mod_edges} WHERE edge_type = 'depends'), f AS (SELECT node_id, name, path FROM {mods} WHERE node_type = 'file'),
 target AS (SELECT node_id FROM f WHERE contains(name, 'f1') OR contains(path, 'src3/')), need AS (SELECT node_id FROM target UNION SELECT dst FROM e WHERE src IN (SELECT node_id FROM target)),
 scope AS (SELECT node_id FROM need UNION SELECT src FROM e WHERE dst IN (SELECT node_id FROM need)), k AS (SELECT f.node_id, f.name, d.name AS first FROM f JOIN scope USING (node_id) LEFT JOIN e ON e.src = f.node_id LEFT JOIN f d ON d.node_id = e.dst)
SELECT node_id, row_number() OVER (ORDER BY greatest(name, coalesce(first, name)), CASE WHEN coalesce(first, name) > name THEN 1 ELSE 0 END, name) - 1 AS position FROM k""")
def g20_topological_files(t):
    return G.topological_files(t.mods, t.mod_edges.where("edge_type = 'depends'"), ["f1", "src3/"])


STEPS = "SELECT CAST(p_partkey AS BIGINT) AS node_id, CASE WHEN p_partkey % 3 = 0 THEN 'file' ELSE 'store' END AS node_type, CASE WHEN p_partkey <= 3 THEN 100 + p_partkey ELSE p_partkey % 7 END AS level, 150 + 40 * (p_partkey % 4) AS ms, CAST(p_size AS DOUBLE) / 50 AS risk, CAST(p_size AS DOUBLE) / 10 AS score FROM {part}"


@query(f"""WITH s AS ({STEPS}) SELECT 'parallelize' AS kind, min(node_id) AS node_id, CAST(1 AS BIGINT) AS n, CAST(min(ms) AS DOUBLE) * CAST(0.3 AS DOUBLE) AS saving FROM s GROUP BY level HAVING count(*) = 1 AND min(ms) > 200
UNION ALL SELECT 'batch', NULL, count(*), count(*) * 20.0::DOUBLE FROM s WHERE node_type = 'file' HAVING count(*) > 5
UNION ALL SELECT 'skip', NULL, count(*), CAST(sum(ms) AS DOUBLE) FROM s WHERE risk < 0.1 AND score < 1 HAVING count(*) > 3
UNION ALL SELECT 'reorder', node_id, 1, 500 * CAST(0.1 AS DOUBLE) FROM s WHERE node_id BETWEEN 10 AND 20 AND risk > 0.5""")
def g26_suggestions(t):
    bottleneck = t.part.where("p_partkey BETWEEN 10 AND 20").select(F.col("p_partkey").cast("long").alias("node_id"), F.lit(500.0).alias("duration"))
    return G.suggestions(t.sql(STEPS), bottleneck)


@query("SELECT count(*) AS steps, CAST(4 AS BIGINT) AS groups, (SELECT max(k) FROM (SELECT count(*) AS k FROM {nodes} GROUP BY CASE node_type WHEN 'type' THEN 0 WHEN 'route' THEN 1 WHEN 'file' THEN 3 ELSE 2 END)) AS widest, count(*) * 2.0::DOUBLE AS total, 8.0::DOUBLE AS critical, count(*) / 4.0::DOUBLE AS speed_up FROM {nodes}")
def g22_plan_summary(t):
    return G.plan_summary(t.nodes, t.edges, t.nodes.select("node_id", F.lit(2.0).alias("cost")))


@query("""SELECT doc_id AS id, 'missing' AS conflict FROM {registry} WHERE doc_id % 6 = 0
UNION ALL SELECT doc_id, 'collision' FROM {registry} WHERE doc_id % 6 = 1 OR doc_id % 6 = 5
UNION ALL SELECT doc_id, 'type-mismatch' FROM {registry} WHERE doc_id % 6 IN (2, 5)
UNION ALL SELECT doc_id, 'circular' FROM {registry} WHERE doc_id % 6 = 3
UNION ALL SELECT doc_id, 'chain' FROM {registry} WHERE doc_id % 6 = 4 AND doc_id % 5 <> 0""")
def g32_all_conflicts(t):
    r, six = t.registry, F.col("doc_id") % 6
    own = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    meta = lambda x: F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("c"), x)
    differ = six.isin(1, 5)
    matches = r.select(F.col("doc_id").alias("id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.when(six == 4, own).alias("path"), F.when(six == 3, "page").otherwise("none").alias("page"), (six != 0).alias("matched"), (~differ).alias("exact"),
                       meta(F.lit("3")).alias("meta"), meta(F.when(differ, "4").otherwise("3")).alias("other_meta"), F.lit("f(): void").alias("signature"), F.when(six.isin(2, 5), "f(): any").otherwise("f(): void").alias("other_signature"))
    # a chain of three files back to the first, or (each fifth id) of two only
    step = lambda k: F.concat(own, F.lit(f"/{k}"))
    long, short = r.where((six == 4) & (F.col("doc_id") % 5 != 0)), r.where((six == 4) & (F.col("doc_id") % 5 == 0))
    links = long.select(own.alias("path"), step(1).alias("name")).unionByName(long.select(step(1).alias("path"), step(2).alias("name"))).unionByName(long.select(step(2).alias("path"), own.alias("name")))
    links = links.unionByName(short.select(own.alias("path"), step(1).alias("name"))).unionByName(short.select(step(1).alias("path"), own.alias("name"))).unionByName(r.limit(1).select(F.lit("page").alias("path"), F.lit("x").alias("name")))
    return I.conflicts(matches, links)


SIGNATURES = [  # old, new, compatible, direction, changes
    ('{"params": [{"name": "a", "type": "string"}], "returnType": "void"}', '{"params": [{"name": "a", "type": "string | number"}], "returnType": "undefined"}', True, "covariant", ""),
    ('{"params": [{"name": "a", "type": "string | number"}], "returnType": "string"}', '{"params": [{"name": "a", "type": "string"}], "returnType": "string"}', False, "contravariant", "type-narrowed"),
    ('{"params": [], "returnType": "string"}', '{"params": [{"name": "b", "type": "number"}], "returnType": "number"}', False, "invariant", "added-required-param,return-type-changed"),
    ('{"params": [{"name": "a", "type": "any"}, {"name": "b", "type": "T"}]}', '{"params": [{"name": "a", "type": "X"}, {"name": "b", "type": "U", "optional": true}, {"name": "c", "type": "V", "rest": true}]}', True, "covariant", ""),
    ('{"params": [{"name": "a", "type": "x"}], "returnType": "Promise<number[]>", "isAsync": true}', '{"params": [], "returnType": "Promise<number[]>", "isAsync": false}', False, "contravariant", "removed-param,async-changed"),
    ('{"params": [], "returnType": "null", "typeParams": ["T"]}', '{"params": [], "returnType": "string | null", "typeParams": []}', True, "covariant", "generic-constraint-added"),
    ('{"params": [], "returnType": "Promise<string>"}', '{"params": [], "returnType": "Promise<number>"}', False, "contravariant", "return-type-changed"),
]
_pick = lambda k, rows, of=lambda x: x: " ".join(f"WHEN {i} THEN {of(r[k])}" for i, r in enumerate(rows))
_text = lambda x: "'" + x.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


@query(f"SELECT doc_id, CASE doc_id % 7 {_pick(2, SIGNATURES, str)} END AS compatible, CASE doc_id % 7 {_pick(3, SIGNATURES, _text)} END AS direction, CASE doc_id % 7 {_pick(4, SIGNATURES, _text)} END AS changes FROM {{registry}}")
def x15_structural_subtyping(t):
    found = I.subtyping(_case(t, *(r[0] for r in SIGNATURES)), _case(t, *(r[1] for r in SIGNATURES)))
    return t.registry.select("doc_id", found.alias("x")).select("doc_id", "x.compatible", "x.direction", F.array_join("x.changes", ",").alias("changes"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'anonymous' ELSE 'f' || CAST(doc_id AS STRING) END || '(' || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a: string' WHEN 2 THEN 'a: any?, ...b: number[]' ELSE 'c: T' END || ')' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ': void' END AS text FROM {registry}")
def x10_signature_text(t):
    one = lambda n, k, optional=False, rest=False: F.struct(F.lit(n).alias("name"), F.lit(k).cast("string").alias("type"), F.lit(optional).alias("optional"), F.lit(rest).alias("rest"))
    none = F.array().cast("array<struct<name:string,type:string,optional:boolean,rest:boolean>>")
    params = _case(t, none, F.array(one("a", "string")), F.array(one("a", None, True), one("b", "number[]", rest=True)), F.array(one("c", "T")))
    name = F.when(F.col("doc_id") % 4 != 3, F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    return t.registry.select("doc_id", I.signature_text(name, params, F.when(F.col("doc_id") % 3 != 0, "void")).alias("text"))


MERGES = [  # target, source, merged, provenance, conflicts
    ('{"a": 1}', '{"b": [1, 2]}', '{"a":1,"b":[1,2]}', "b=source", ""),
    ('{"a": {"x": 1, "y": 2}}', '{"a": {"x": 1, "y": 3, "z": 4}}', '{"a":{"x":1,"y":2,"z":4}}', "a.x=target,a.y=target,a.z=source,a=merged", 'a.y: target="2" vs source="3"'),
    ('{"l": [1, {"k": 1}]}', '{"l": [{"k": 1}, 2, 2]}', '{"l":[1,{"k":1},2]}', "l=merged", ""),
    ('{"s": "x", "n": null}', '{"s": {"k": 1}, "n": null}', '{"s":"x","n":null}', "n=target,s=target", 's: target=""x"" vs source="{"k":1}"'),
    ("[1]", '{"a": 1}', None, None, None),
]
_maybe = lambda x: "NULL" if x is None else _text(x)


@query(f"SELECT doc_id, CASE doc_id % 5 {_pick(2, MERGES, _maybe)} END AS merged, CASE doc_id % 5 {_pick(3, MERGES, _maybe)} END AS provenance, CASE doc_id % 5 {_pick(4, MERGES, _maybe)} END AS conflicts FROM {{registry}}")
def x26_merged_objects(t):
    found = I.merged_objects(_case(t, *(r[0] for r in MERGES)), _case(t, *(r[1] for r in MERGES)))
    said = F.array_join(F.array_sort(F.transform(F.map_entries("x.provenance"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return t.registry.select("doc_id", found.alias("x")).select("doc_id", "x.merged", said.alias("provenance"), F.array_join("x.conflicts", ",").alias("conflicts"))


@query("SELECT doc_id, 'a ' || status || chr(10) || '  b' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || '// from ' || CAST(doc_id AS STRING) || chr(10) || 'c' || chr(10) || ' c' ELSE chr(10) || chr(10) || '// from ' || CAST(doc_id AS STRING) || chr(10) || 'a' END AS text FROM {registry}")
def o17_line_merge(t):
    target = F.concat(F.lit("a "), "status", F.lit("\n  b"))
    source = _case(t, F.lit("b  \n\n \n"), F.concat(F.lit("\tb\nc\n c\n a "), "status"), F.lit("a\nb"))
    return t.registry.select("doc_id", I.merged_lines(target, source, F.concat(F.lit("// from "), F.col("doc_id").cast("string"))).alias("text"))


BROKEN = [  # text, its issues as line:issue:severity
    ("a {\n}", []), ("a { b {\n", ["0:braces:warning"]), ("f((((", ["0:parentheses:error"]), ("x = 'open\ny", ["1:string:warning"]), ("// don't\ny", []), ("x = 'two\nlines'", []), ("it\\'s\nn", []), ("x = '`\ny", []), ("last'", []), ("}}}\n* don't\n'q\n)", ["0:braces:error", "0:parentheses:warning", "3:string:warning"]),
]


@query(" UNION ALL ".join(f"SELECT doc_id, CAST({x.split(':')[0]} AS INT) AS line, '{x.split(':')[1]}' AS issue, '{x.split(':')[2]}' AS severity FROM {{registry}} WHERE doc_id % 10 = {i}" for i, (_, xs) in enumerate(BROKEN) for x in xs))
def x27_syntax_issues(t):
    return I.syntax_issues(t.registry.select(F.col("doc_id").alias("path"), _case(t, *(x for x, _ in BROKEN)).alias("text"))).withColumnRenamed("path", "doc_id")


ROUTED = [  # text, framework, format
    ("const r = createRouter({ history: createWebHistory(), routes: [] })", "vue-router-4", "createRouter"), ("createRouter({\n routes: x })", "vue-router-4", "createRouter"), ("const routes = [];\nexport default createBrowserRouter(routes)", "react-router-6", "createBrowserRouter"),
    ('<Route path="/" element={<A/>} />', "react-router-6", "array"), ("export default function Layout() {}", "next-app-router", "file-based"), ("export async function getStaticProps() {}", "next-pages-router", "file-based"), ("router.addRoute({ path: '/' })", "vue-router-4", "programmatic"),
    ("const routes = [{ path: '/' }]", "generic-array", "array"), ("let routes = { a: 1 }", "generic-object", "object"), ("import { useRouter } from 'vue-router'", "vue-router-4", "createRouter"), ("import { Link } from 'react-router-dom'", "react-router-6", "array"), ("import x from 'next/navigation'", "next-app-router", "file-based"), ("nothing here", "unknown", "unknown"),
]


@query(f"SELECT doc_id, CASE doc_id % 13 {_pick(1, ROUTED, _text)} END AS framework, CASE doc_id % 13 {_pick(2, ROUTED, _text)} END AS format FROM {{registry}}")
def x31_router_framework(t):
    return t.registry.select("doc_id", I.router_framework(_case(t, *(r[0] for r in ROUTED))).alias("x")).select("doc_id", "x.framework", "x.format")


@query("SELECT 'src/' || dir || '/m' || CAST(doc_id AS STRING) || '.js' AS importer, CASE doc_id % 8 WHEN 0 THEN '@own/ui/button' WHEN 1 THEN 'lib/feature/x' WHEN 2 THEN '@/' || lang2 || '/f' || CAST(doc_id AS STRING) WHEN 3 THEN 'left-pad/index' WHEN 4 THEN './' || lang2 || '/f' || CAST(doc_id AS STRING) WHEN 5 THEN '../gone' WHEN 6 THEN 'nowhere' ELSE '@/no/f' END AS specifier, CASE doc_id % 8 WHEN 0 THEN 'workspace' WHEN 1 THEN 'package-exports' WHEN 2 THEN 'tsconfig-paths' WHEN 3 THEN 'node-modules' WHEN 4 THEN 'relative' ELSE 'unresolved' END AS via FROM (SELECT *, split_part(filepath, '/', 3) AS lang2 FROM {registry})")
def x28_checked_imports(t):
    n, lang = F.col("doc_id").cast("string"), F.split_part("filepath", F.lit("/"), F.lit(3))
    spec = _case(t, "@own/ui/button", "lib/feature/x", F.concat(F.lit("@/"), lang, F.lit("/f"), n), "left-pad/index", F.concat(F.lit("./"), lang, F.lit("/f"), n), "../gone", "nowhere", "@/no/f")
    rows = t.registry.select(F.concat(F.lit("src/"), "dir", F.lit("/m"), n, F.lit(".js")).alias("importer"), spec.alias("specifier"))
    dirs = [f"src/src{k}/*" for k in range(40)]
    return I.checked_imports(rows, t.registry.select(F.col("filepath").alias("path")), ["@own/ui"], ["./feature/*"], {"@/*": dirs}, ["left-pad"])


COMMITS = [  # payload, error
    ('{"hash": "abc", "filesChanged": 3}', None), ("[1]", "payload must be a JSON object"), ("no json", "payload must be a JSON object"), ('{"hash": "a", "files": 1}', "unknown field: files"), ('{"subject": "x"}', "hash required (string)"), ('{"hash": ""}', "hash required (non-empty)"), ('{"hash": 5}', "hash required (string)"),
    ('{"hash": "a", "author": 7}', "author must be a string"), ('{"hash": "a", "shortHash": "' + "0" * 41 + '"}', "shortHash too long (max 40)"), ('{"hash": "a", "filesChanged": "3"}', "filesChanged must be a number"), ('{"hash": "a", "filesChanged": 1.5}', "filesChanged must be an integer"), ('{"hash": "a", "filesChanged": -1}', "filesChanged must be >= 0"), ('{"hash": "a", "filesChanged": 10001}', "filesChanged exceeds sanity cap (10000)"), ('{"hash": "a", "branch": null, "filesChanged": null}', None),
]


@query(f"SELECT doc_id, CASE doc_id % 14 {_pick(1, COMMITS, _maybe)} END AS error FROM {{registry}}")
def f30_commit_error(t):
    return t.registry.select("doc_id", I.commit_error(_case(t, *(r[0] for r in COMMITS))).alias("error"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.85 WHEN 5 THEN 0.5 WHEN 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, CASE doc_id % 6 WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS impact, CASE doc_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 4 THEN 'low' ELSE 'high' END AS risk FROM {registry}")
def u04_conflict_metadata(t):
    return t.registry.select("doc_id", I.conflict_metadata(_case(t, "rename", "merge", "overwrite", "custom", None, "other")).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, CASE WHEN bytes > 900 THEN 'merge' WHEN doc_id % 2 = 0 THEN 'rename' END AS strategy FROM {registry}")
def u03_strategy_chain(t):
    works = lambda s: ((s == "merge") & (F.col("bytes") > 900)) | ((s == "rename") & (F.col("doc_id") % 2 == 0))
    return t.registry.select("doc_id", I.first_success(F.array(F.lit("merge"), F.lit("overwrite"), F.lit("rename")), works).alias("strategy"))


def _shout(text):
    """A caller's transform: fails on what starts with a C, and gives no text for what starts with a D."""
    if text.startswith("C"):
        raise ValueError(text)
    return 5 if text.startswith("D") else text.lower() + "!"


@query("SELECT doc_id, CASE WHEN phase IN ('CONCEPT', 'DEVELOPMENT') THEN phase ELSE lower(phase) || '!' END AS text FROM {registry}")
def u02_user_transform(t):
    return t.registry.select("doc_id", I.transformed(F.col("phase"), _shout).alias("text"))


@query("SELECT doc_id, r.path, r.component, r.depth, r.parent FROM {registry} CROSS JOIN (SELECT '/a' AS path, 'Home' AS component, 0 AS depth, '' AS parent, 0 AS k UNION ALL SELECT '/b', '(Dynamic Import)', 0, '', 1 UNION ALL SELECT 'c', 'C', 1, '/b', 1 UNION ALL SELECT 'd', NULL, 2, 'c', 1) r WHERE r.k = 0 OR doc_id % 2 = 0")
def n12_nested_routes(t):
    below = F.when(F.col("doc_id") % 2 == 0, ", { path: '/b', component: () => import('./b.vue'), children: [{ path: 'c', component: C, children: [{ path: 'd' }, { name: 'no path' }] }] }").otherwise("")
    text = F.concat(F.lit("import x from 'y'\nconst routes = [{ path: '/a', component: Home, meta: { deep: [{ path: 'not' }] } }, ...more"), below, F.lit("]"))
    return t.registry.select("doc_id", F.explode(J.routes(text)).alias("x")).select("doc_id", "x.path", "x.component", "x.depth", "x.parent")


@query("SELECT 's' || CAST(doc_id AS STRING) AS store, x.part, x.name FROM {registry} CROSS JOIN (SELECT 'state' AS part, 'items' AS name, 0 AS k UNION ALL SELECT 'state', 'n', 0 UNION ALL SELECT 'getter', 'double', 0 UNION ALL SELECT 'action', 'load', 0 UNION ALL SELECT 'action', 'reset', 0 UNION ALL SELECT 'setup', NULL, 1) x WHERE x.k = CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END")
def n11_store_details(t):
    options = "{ state: () => ({ items: [], n: 0 }), getters: { double: (s) => s.n * 2 }, actions: { async load(a, b) { this.n = { k: 1 } }, reset() {} } })"
    text = F.concat(F.lit("export const use = defineStore('s"), F.col("doc_id").cast("string"), F.lit("', "), F.when(F.col("doc_id") % 3 == 0, "() => { const a = ref({ state: 1 }); return { a } })").otherwise(options))
    return t.registry.select(F.explode(J.stores(text)).alias("x")).select("x.*")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN './a.js' WHEN 1 THEN './m.mjs,./c.cjs' WHEN 2 THEN './x.js,./y/z.js,./w.js' ELSE '' END AS leaves, doc_id % 4 IN (0, 2) OR doc_id % 4 = 1 AS public FROM {registry}")
def x33_public_exports(t):
    leaves = J.export_leaves(_case(t, '"./a.js"', '{".": {"import": "./m.mjs", "require": "./c.cjs"}}', '{"./x": ["./x.js", {"deep": {"er": "./y/z.js"}}], "./w": "./w.js"}', "{}"))
    path = _case(t, "lib/a.js", "src/index.ts", "pkg\\y\\z.js", "src/index.js")
    return t.registry.select("doc_id", F.array_join(leaves, ",").alias("leaves"), J.is_public(path, leaves).alias("public"))


@query("SELECT doc_id AS id, x.kind, x.specifier, count(*) AS n FROM {registry} JOIN (SELECT 0 AS k, 'side-effect' AS kind, 'reset.css' AS specifier UNION ALL SELECT 0, 'dynamic', './late.js' UNION ALL SELECT 1, 'star', './parts' UNION ALL SELECT 1, 'reexport', './one' UNION ALL SELECT 2, 'dynamic', './a.js' UNION ALL SELECT 2, 'dynamic', './b.js' UNION ALL SELECT 2, 'require', 'm') x ON x.k = doc_id % 4 GROUP BY 1, 2, 3")
def x07_import_forms(t):
    text = _case(t, "import 'reset.css';\nif (x) { await import('./late.js') }", "export * from './parts';\nexport { one, two as b } from './one';", "const m = ok ? import('./a.js') : import(`./b.js`);\ntry { require('m') } catch {}", "// import 'no'\nimportant('x')")
    files = t.registry.select(F.col("doc_id").alias("id"), F.lit("a.js").alias("path"), text.alias("text"))
    return P.imports(files.withColumn("path", F.col("id").cast("string"))).groupBy(F.col("path").cast("long").alias("id"), "kind", "specifier").agg(F.count("*").alias("n"))
