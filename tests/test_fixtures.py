"""Imports, source text, cards, snapshots, streams and sources on small fixtures."""

import datetime as dt
import json

import pytest

from lodestone.functions import scalars, source_text
from lodestone.operators import aggregates, gaps, lookups, relations, search, snapshots
from lodestone.sources import files, sinks
from lodestone.streaming import changes
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("importer", "specifier", "present", "expected"),
    [
        ("lib/shop/cart.js", "./price.js", ["lib/shop/cart.js", "lib/shop/price.js"], "lib/shop/price.js"),
        ("lib/shop/cart.js", "./price", ["lib/shop/price.js"], "lib/shop/price.js"),
        ("lib/shop/ui/row.js", "../../tax/rates", ["lib/tax/rates.js"], "lib/tax/rates.js"),
        ("lib/cart.js", "./money", ["lib/money/index.js"], "lib/money/index.js"),
        ("lib/cart.js", "./money/", ["lib/money/index.js"], "lib/money/index.js"),
        ("lib/cart.js", "./money/round/", ["lib/money/round.js"], "lib/money/round.js"),
        ("lib/cart.js", "path", ["lib/path.js"], None),
        ("lib/cart.js", "node:os", ["lib/os.js"], None),
        ("lib/cart.js", "@team/kit", ["lib/kit.js"], None),
        ("lib/cart.js", "/root", ["root.js"], None),
        ("lib/cart.js", "./ghost", ["lib/price.js"], None),
        ("lib/shop/cart.js", "./price", ["lib/price.js", "lib/shop/price.js", "price.js"], "lib/shop/price.js"),
        ("lib\\shop\\cart.js", "./price", ["lib\\shop\\price.js"], "lib\\shop\\price.js"),
        ("lib/cart.js", "", ["lib/price.js"], None),
        ("lib/cart.js", None, ["lib/price.js"], None),
    ],
)
def test_import_resolution(spark, importer, specifier, present, expected):
    asked = spark.createDataFrame([(importer, specifier)], "importer string, specifier string")
    known = spark.createDataFrame([(p,) for p in present], "filepath string")
    assert [r.target for r in relations.resolve_imports(asked, known).collect()] == [expected]


SHAPES = [
    ("t.js", "import clock from 'timers-x';", {("default", "timers-x", "clock")}, set()),
    ("t.js", "import { up, down } from 'moves';", {("named", "moves", " up, down ")}, set()),
    ("t.js", "import * as geo from 'maps';", {("namespace", "maps", "geo")}, set()),
    ("t.js", "import 'fonts';", {("side-effect", "fonts", "")}, set()),
    ("t.js", "const late = async () => (await import('charts')).draw;", {("dynamic", "charts", "")}, set()),
    ("t.js", "const os = require('os');\nvar { sep } = require('paths');", {("require", "os", ""), ("require", "paths", "")}, set()),
    ("t.js", "class Tree {}\nmodule.exports = Tree;", set(), {"Tree"}),
    ("t.js", "let left = 1, right = 2;\nmodule.exports = { left, right };", set(), {"left", "right"}),
    ("t.js", "exports.open = () => 1;\nexports.shut = 'x';", set(), {"open", "shut"}),
    ("t.ts", "let one = 1;\nlet two = 2;\nexport { one, two as zwei };", set(), {"one", "zwei"}),
    ("t.js", "export let size = 3;\nexport function grow() {}\nexport class Leaf {}", set(), {"size", "grow", "Leaf"}),
    ("t.js", "export default function run() {}", set(), {"run"}),
    ("t.js", "export * from './branches';", {("star", "./branches", "")}, set()),
    ("t.vue", "<template><p/></template>\n<script>\nimport tree from 'trees';\nexport default {};\n</script>", {("default", "trees", "tree")}, {"default"}),
    ("t.js", "// import gone from 'gone';\n/* require('gone') */", set(), set()),
]


@pytest.mark.parametrize(("path", "text", "imports", "exports"), SHAPES)
def test_source_shapes(spark, path, text, imports, exports):
    df = spark.createDataFrame([(path, text)], "path string, text string")
    assert {(r.kind, r.specifier, r.names) for r in source_text.imports(df).collect()} == imports
    assert {r.name for r in source_text.exports(df).collect()} == exports


def test_star_closure(spark):
    stars = spark.createDataFrame([("a", "b"), ("b", "c")], "path string, target string")
    own = spark.createDataFrame([("c", "z"), ("c", "default"), ("a", "x")], "path string, name string")
    assert {(r.path, r.name) for r in source_text.star_closure(stars, own).collect()} == {("a", "x"), ("a", "z"), ("b", "z"), ("c", "z"), ("c", "default")}


def test_report_nodes(spark):
    rows = [
        ("p", "file", "Files:\n 1: src/a.js\n 2: [COMPARE] x.js\n 3: src/b.js\n"),
        ("p", "store", "--- Store ID: user ---\nstate\n--- Store ID: cart ---\n"),
        ("p", "route", "  - Path: /home\n    Name: Home\n"),
        ("p", "command", "Command: get_data\n  Declared in: x.rs\nCommand: get_data\n"),
        ("p", "type", "--- File: t.ts ---\nexport interface Foo {}\ntype Bar = 1\n--- File: u.ts ---\nenum Baz {}\n"),
        ("p", "component", "File Name: A.vue (src/A.vue)\n"),
    ]
    got = {(r.node_type, r.name, r.path) for r in source_text.ingest(spark.createDataFrame(rows, "project string, kind string, text string")).collect()}
    assert got == {("file", "src/a.js", "src/a.js"), ("file", "src/b.js", "src/b.js"), ("store", "user", None), ("store", "cart", None), ("route", "/home", "/home"), ("command", "get_data", None), ("type", "Foo", "t.ts"), ("type", "Bar", "t.ts"), ("type", "Baz", "u.ts"), ("component", "A.vue", "src/A.vue")}


def test_scalars(spark):
    code = "// note\nfunction f(a) {\n  if (a && b) { return 1; }\n  for (;;) {}\n}\n@@@\n// @@@ todo\n/**\n * @param x the x\n */"
    df = spark.createDataFrame([(code, "a:b:12", "{{ a }} {{b}} {{a}}", "src/.hidden", "x.test.js")], "t string, i string, v string, p string, n string")
    r = df.select(
        scalars.needs_review(F.col("t")), scalars.cyclomatic(F.col("t")), scalars.nesting(F.col("t")), scalars.loc(F.col("t")), scalars.balanced(F.lit("(a[")), scalars.trailing_id(F.col("i")), scalars.template_variables(F.col("v")), scalars.extname(F.col("p")), scalars.purpose(F.col("n")), source_text.doc_tags(F.col("t")), source_text.is_pure(F.lit("return a + b")), scalars.escape_toml(F.lit('a"\\\n')), scalars.iso_timestamp(F.lit("2026-01-02T03:04:05.000Z")) == scalars.iso_timestamp(F.lit("2026-01-02 03:04:05"))
    ).first()
    assert tuple(r) == (2, 4, 2, 5, ["parentheses", "brackets"], 12, ["a", "b"], "", "Verifies behaviour", {"param": "x the x"}, True, 'a\\"\\\\\\n', True)


def card(path, status="GREEN", reach=0.5, phase="DEVELOPMENT", purpose=None, exports=(), kinds=(), imports=(), by=()):
    return {
        "fingerprint": f"{path}||x", "filepath": path, "status": status, "reachabilityScore": reach, "lifecyclePhase": phase, "intent": {"purpose": purpose},
        "exports": [{"name": e} for e in exports], "imports": [{"source": "m", "importType": k} for k in kinds], "connections": {"imports": list(imports), "importedBy": list(by)},
    }


def test_cards_and_gaps(spark, tmp_path):
    rows = [
        card("src/a.js", "RED", 0.0, "CONCEPT", "real", (), ("require",), ("src/b.js||x", "gone||x")),
        card("src/b.js", "GREEN", 0.1, purpose="(not set)", exports=("x",), kinds=("default",), by=("src/a.js||x",)),
        card("lib/c.js", "GREEN", 0.9, "PRODUCTION", "", ("y",), ("require", "named")),
    ]
    for i, r in enumerate(rows):
        (tmp_path / f"{i}.json").write_text(json.dumps(r))
    (tmp_path / "bad.json").write_text("{ no json")
    cards = files.cards(spark, str(tmp_path)).cache()
    assert cards.count() == 3
    assert {r.phase: r.n for r in gaps.phases(cards).collect()} == {"CONCEPT": 1, "DEVELOPMENT": 1, "PRODUCTION": 1}
    assert {r.status: (r.n, r.no_exports, r.no_importers, r.low_reach) for r in gaps.statuses(cards).collect()} == {"RED": (1, 1, 1, 0), "GREEN": (2, 0, 0, 1)}
    assert {r.dir: (r.total, r.with_intent, r.coverage) for r in gaps.intent_coverage(cards).collect()} == {"src": (2, 1, "50.0"), "lib": (1, 0, "0.0")}
    assert tuple(gaps.export_coverage(cards).first()) == (2, 1, 2, 2)
    assert gaps.connection_totals(cards).select("imports", "resolved", "orphan", "isolated").first() == (2, 1, 1, 1)
    assert gaps.connection_totals(cards.limit(0)).select("imports", "resolved", "orphan", "isolated").first() == (0, 0, 0, 0)
    wanted = spark.createDataFrame([("a.js",), ("z.js",)], "module string")
    assert {r.module: r.present for r in gaps.module_coverage(cards, wanted).collect()} == {"a.js": True, "z.js": False}


@pytest.mark.parametrize(("status", "reach", "impact", "expected"), [("RED", 0.0, 0, [("orphan", "error")]), ("YELLOW", 0.5, 2, [("under-connected", "warning")]), ("GREEN", 0.1, 1, [("under-imported", "warning")]), ("YELLOW", 0.5, 25, [("under-connected", "warning"), ("high-impact", "info")])])
def test_insight_ladder(spark, status, reach, impact, expected):
    df = spark.createDataFrame([("f", status, reach, impact)], "filepath string, status string, reach double, impact int")
    assert [(r.category, r.severity) for r in aggregates.insights_of(df).collect()] == expected


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, v string, seen int")
    new = spark.createDataFrame([(2, "B", 0), (3, "C", 0)], "id int, v string, seen int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(snapshots.upsert(old, new, ["id"])) == [(1, "a", 5), (2, "B", 0), (3, "C", 0)]
    assert rows(snapshots.upsert(old, new, ["id"], ["seen"])) == [(1, "a", 5), (2, "B", 6), (3, "C", 0)]
    assert rows(snapshots.insert_missing(old, new, ["id"])) == [(1, "a", 5), (2, "b", 6), (3, "C", 0)]
    log = spark.createDataFrame([("CREATE", dt.datetime(2020, 1, 1)), ("UPDATE", dt.datetime(2020, 1, 1)), ("UPDATE", dt.datetime(2026, 1, 1))], "kind string, ts timestamp")
    assert snapshots.retention(log, F.lit("2025-01-01").cast("timestamp")).count() == 2
    assert lookups.snapshot_diff(old, new, "id", ["v"]).count() == 3


def test_publish_is_read_back(spark, tmp_path):
    root = str(tmp_path)
    for version in (1, 2):
        snapshots.publish(spark, root, {"registry": spark.createDataFrame([(version,)], "v int")}, version)
    assert snapshots.current(spark, root, "registry").first()[0] == 2


def test_debounce_and_flush(spark):
    t0 = dt.datetime(2026, 1, 1)
    at = lambda ms: t0 + dt.timedelta(milliseconds=ms)
    rows = [("a", "change", at(i * 10), "h") for i in range(25)] + [("b", "add", at(300), "h"), ("a", "add", at(100), "h"), ("c", "add", at(5000), "h")]
    df = spark.createDataFrame(rows, "path string, type string, ts timestamp, sha string")
    assert sorted((r.path, r.type, r.n) for r in changes.debounce(df).collect()) == [("a", "add", 1), ("a", "change", 25), ("b", "add", 1), ("c", "add", 1)]
    assert [(r.path, r.type) for r in changes.flushes(df).orderBy("start", "path", "type").collect()] == [("a", "add"), ("a", "change"), ("b", "add"), ("c", "add")]


def test_stream_applies_batches(spark, tmp_path):
    root, source = str(tmp_path / "out"), tmp_path / "in"
    source.mkdir()
    snapshots.publish(spark, root, {"registry": spark.createDataFrame([("a", "1"), ("b", "1")], "path string, sha string"), "mutations": spark.createDataFrame([], "path string, kind string")}, 0)
    lines = [("a", "change", "2"), ("b", "unlink", None), ("c", "add", "1"), ("d", "unlink", None)]
    (source / "1.json").write_text("".join(json.dumps({"path": p, "type": k, "ts": f"2026-01-01T00:00:0{i}Z", "sha": s}) + "\n" for i, (p, k, s) in enumerate(lines)))
    seen = []
    changes.run_batches(changes.events(spark, str(source)), root, lambda m, _: seen.extend((r.path, r.kind) for r in m.collect()), str(tmp_path / "ck")).start().awaitTermination()
    assert sorted(seen) == [("a", "UPDATE"), ("b", "DELETE"), ("c", "CREATE")]
    assert sorted(tuple(r) for r in snapshots.current(spark, root, "registry").collect()) == [("a", "2"), ("c", "1")]


def test_watermarked_stream_of_bursts(spark, tmp_path):
    (tmp_path / "1.json").write_text("".join(json.dumps({"path": "a", "type": "add", "ts": f"2026-01-01T00:00:{s:02d}Z", "sha": "x"}) + "\n" for s in (0, 0, 30, 59)))
    q = changes.debounce(changes.events(spark, str(tmp_path))).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT n FROM bursts").collect()) == [1, 2]


def test_hooks_run_by_priority_and_survive_failures():
    hooks, seen = changes.Hooks(), []
    hooks.register("x", lambda: seen.append(2), 20)
    hooks.register("x", lambda: 1 / 0, 15)
    hooks.register("x", lambda: seen.append(1), 10)
    assert hooks.run("x")["ok"] == 2 and seen == [1, 2]
    assert hooks.run("y") == {"ok": 0, "fail": 0, "errors": []}


def test_scan_and_identity(spark, tmp_path):
    for name in ("src/a.js", "src/b.py", "node_modules/x.js", "src/c.bin", "connection-state.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("let a = 1")
    df = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in df.collect()) == ["src/a.js", "src/b.py"]
    assert [r.text for r in files.texts(df, "src").where("path = 'src/a.js'").collect()] == ["let a = 1"]
    at = lambda y: dt.datetime(y, 1, 1)
    asked = spark.createDataFrame([("a", at(2020), at(2021)), ("b", at(1970), at(2021)), ("c", at(2020), at(2021))], "path string, birthtime timestamp, mtime timestamp")
    got = {r.path: (r.birth, r.origin) for r in files.identity(asked, spark.createDataFrame([("c", "old")], "path string, birth string")).collect()}
    assert got == {"a": ("2020-01-01T00:00:00.000Z", "stat-birthtime"), "b": ("2021-01-01T00:00:00.000Z", "mtime-fallback"), "c": ("old", "reused-persisted")}


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables, one of them a file, the others folders of parts."""
    from lodestone.plans.queries_sources import NAMES

    for n in NAMES:
        spark.range(8).repartition(3).write.parquet(str(tmp_path / f"{n}.parquet"))
    part = next((tmp_path / "region.parquet").glob("part-*.parquet")).rename(tmp_path / "one")
    (tmp_path / "region.parquet").rename(tmp_path / "_other")
    part.rename(tmp_path / "region.parquet")
    (tmp_path / "region.txt").write_text("x")
    return tmp_path, sorted(f"{n}.parquet" for n in NAMES)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_scan_takes_tables_in_parts(spark, tables, scheme):
    from lodestone import registry

    folder, names = tables
    registry.load()
    assert sorted(tuple(r) for r in registry.QUERIES["s01_scan"](spark, f"{scheme}{folder}").collect()) == [(n, True) for n in names]
    deep = spark.createDataFrame([("a.b/c.js", 1), ("t.js/part-0.js", 2), ("x/t.js/part-1.js", 3), ("x/t.js/part-2.js", 4), ("no/ext", 5), ("no/other", 6)], "path string, bytes long")
    assert sorted(tuple(r) for r in files.whole(deep).collect()) == [("a.b/c.js", 1), ("no/ext", 5), ("no/other", 6), ("t.js", 2), ("x/t.js", 7)]


def test_a_scan_passes_by_own_tables_in_parts(spark, tables):
    from lodestone import registry

    registry.load()
    assert [r.path for r in registry.QUERIES["s03_scan_without"](spark, str(tables[0])).collect()] == ["documents.parquet"]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_listing_shows_folders(spark, tables, scheme):
    from lodestone import registry

    folder, names = tables
    registry.load()
    assert sorted(r.path for r in registry.QUERIES["s05_listing"](spark, f"{scheme}{folder}").collect()) == names
    got = {r.path: r.folder for r in files.listing(spark, f"{scheme}{folder}").collect()}
    assert got == {**{n: n != "region.parquet" for n in names}, "region.txt": False}
    assert all(not r.folder and r.path.startswith("part.parquet/part-") for r in files.listing(spark, f"{scheme}{folder}", "part.parquet").collect())


def test_plan_shapes_and_sinks(spark, tmp_path):
    assert [r.id for r in files.plan(spark, '[[steps]]\nid = "a"\n[[steps]]\nid = "b"\n', "steps").orderBy("id").collect()] == ["a", "b"]
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "id string, v int")
    assert files.wrong_shape(df, {"id": "string", "v": "bigint", "w": "int"}) == (["w"], [], ["v"])
    nodes, edges = sinks.assign_ids(df, spark.createDataFrame([("a", "b"), ("a", "zz")], "src string, dst string"))
    assert sorted((r.id, r.node_id) for r in nodes.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert [tuple(r) for r in edges.select("src", "dst").collect()] == [(1, 2)]
    assert sinks.markdown_table(df.orderBy("id"), 2).endswith("… 1 more\n")
    sinks.export(df, str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 3


def test_search(spark):
    df = spark.createDataFrame([(1, "Red widget"), (2, "red bolt"), (3, "blue widget")], "id long, t string")
    index = search.build_index(df, "id", "t", "c")
    assert [r.object for r in search.search(index, ["RED", "widget"]).collect()] == [1]
    assert [r.object for r in search.search(index, ["rid", "bolt"], 1).collect()] == [2]
    assert [(r.term, r.objects) for r in search.suggest(index, "w").collect()] == [("widget", 2)]
    assert search.flush(index, "c").count() == 0
