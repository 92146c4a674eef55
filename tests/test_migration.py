"""Operators of migrations, sinks, sources and streams on odd rows, beside their queries."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import literals
from lodestone.operators import graph, lineage, migration, search, snapshots
from lodestone.sources import cache, files, sinks
from lodestone.streaming import changes


@pytest.mark.parametrize(
    ("source", "target", "accepted", "returned"),
    [
        ("string", "string", True, True), ("string", "string | number", True, True), ("string | number", "string", False, False), ("a | b", "b | a | c", True, False), ("any", "x", True, True), ("x", "any", True, True),
        ("unknown", "x", True, False), ("x", "unknown", False, True), ("never", "x", False, True), ("void", "undefined", False, True), ("Promise<a[]>", "Promise<a[]>", True, True), ("Promise<never>", "Promise<x>", False, True),
        ("null", "Nullable", False, True), ("a[]", "b[]", False, False), (None, "x", True, True), ("x", "", True, True), (" String ", "string", True, True),
    ],
)
def test_assignability(source, target, accepted, returned):
    assert migration.fits(migration.kinds(source), migration.kinds(target), False) is accepted
    assert migration.fits(migration.kinds(source), migration.kinds(target), True) is returned


def test_odd_signatures_and_merges(spark):
    df = spark.createDataFrame([("{}", "{}"), (None, "{}"), ("[]", "{}"), ("x", "{}")], "a string, b string")
    got = df.select(migration.subtyping(F.col("a"), F.col("b")).alias("s"), migration.merged_objects(F.col("a"), F.col("b")).alias("m")).collect()
    assert (got[0].s.compatible, got[0].s.direction, got[0].s.changes, got[0].m.merged) == (True, "covariant", [], "{}")
    assert all(r.s.compatible is None and r.m.merged is None for r in got[1:])
    merged, where, against = migration.merge_values({"a": {"b": {"c": [1]}}, "n": None}, {"a": {"b": {"c": [1, 1, 2], "d": 0}}, "n": {}})
    assert merged == {"a": {"b": {"c": [1, 2], "d": 0}}, "n": None} and where["a.b.d"] == "source" and len(against) == 1


def test_merged_lines(spark):
    df = spark.createDataFrame([("", ""), ("a", None), (None, "a"), ("a\n", "\t a \n\n")], "t string, s string")
    assert [r[0] for r in df.select(migration.merged_lines(F.col("t"), F.col("s"), F.lit("//"))).collect()] == ["", "a", None, "a\n"]


def test_commit_payload_of_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("{}",), ('{"hash": null}',), ('{"hash": "a", "x": 1, "hash2": 2}',)], "p string")
    got = [r[0] for r in df.select(migration.commit_error(F.col("p"))).collect()]
    assert got == ["payload must be a JSON object", "payload must be a JSON object", "hash required (string)", "hash required (string)", "unknown field: x"]


def test_chains(spark):
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("s", "s"), ("l1", "l2"), ("l2", "l3"), ("l3", "l2")], "path string, name string")
    starts = spark.createDataFrame([(1, "n", "a"), (2, "n", "x"), (3, "n", "s"), (4, "n", "l1"), (5, "n", "none")], "id int, name string, path string")
    assert [r.id for r in migration.chained(imports, starts).collect()] == [1]


def test_literals_of_odd_text():
    for text in ("", "routes", "routes: [", "routes: [{", "const routes = [{ path: '/a'", "routes: [[]]", "routes = [,,{path:'/x'},]", "routes: ] }", "defineStore('a', {", "defineStore('a')", "defineStore(x, {})"):
        assert isinstance(literals.route_rows(text), list) and isinstance(literals.store_rows(text), list)
    assert literals.route_rows("routes = [,,{path:'/x'},]") == [("/x", None, None, 0, "")]
    assert literals.route_rows("const routes = [{ path: '/a'") == [("/a", None, None, 0, "")]
    assert literals.route_rows('routes: [{ "path": "/no" }, { path: `/t`, name: n, component: f(x) }]') == [("/t", None, "(other)", 0, "")]


def test_topological_files_with_a_cycle(spark):
    nodes = spark.createDataFrame([(1, "file", "a.js", "p/a.js"), (2, "file", "b.js", None), (3, "file", "c.js", "p/c.js"), (4, "store", "a.js", "p"), (5, "file", "z.js", "z"), (6, "file", "e.js", "e")], "node_id long, node_type string, name string, path string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (6, 1), (1, 4), (1, 1)], "src long, dst long")
    got = [r.node_id for r in graph.topological_files(nodes, edges, ["p/a"]).orderBy("position").collect()]
    assert sorted(got) == [1, 2, 3, 6]  # all on or behind a cycle: by edges among themselves, then name
    assert graph.topological_files(nodes, edges, ["nothing"]).collect() == []
    free = spark.createDataFrame([(1, 2), (6, 1)], "src long, dst long")
    assert [r.node_id for r in graph.topological_files(nodes, free, ["b.js"]).orderBy("position").collect()] == [2, 1, 6]


def test_back_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 2), (4, 4), (5, 1)], "src long, dst long")
    assert sorted(r.cycle for r in graph.back_edge_cycles(edges).collect()) == [[1, 2, 3], [2, 3], [4]]


def test_health_ladder(spark):
    nodes = spark.createDataFrame([(1, "file", "a"), (2, "file", "b"), (3, "file", "c"), (4, "store", "s"), (5, "import", "m"), (6, "import", "m"), (7, "file", "d")], "node_id long, node_type string, name string")
    edges = spark.createDataFrame([(1, 2), (2, 1), (6, 7), (7, 7)], "src long, dst long")
    got = {r.node_id: r.health for r in graph.health(nodes, edges, graph.on_cycles(edges)).collect()}
    assert got == {1: "broken", 2: "broken", 3: "unused", 4: "partial", 5: "broken", 6: "broken", 7: "broken"}


def test_listing_stays_below_its_root(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("1")
    assert [r.path for r in files.listing(spark, str(tmp_path), "a").collect()] == ["a/x.txt"]
    for below in ("../x", "a/../../x", "/etc", "a\\..\\x"):
        with pytest.raises(ValueError):
            files.listing(spark, str(tmp_path), below)


def test_reports_of_empty_tables(spark, tmp_path):
    registry = spark.createDataFrame([], "filepath string, status string, phase string, quality int")
    assert sinks.phase_lines(registry).collect() == [] and sinks.card_lines(registry).collect() == []
    assert [r.line for r in sinks.check_lines(spark.createDataFrame([], "id string, title string, message string"), spark.createDataFrame([], "id string, issue string")).orderBy("place").collect()] == ["# Checks", "0/0 checks pass"]
    summary = sinks.error_summary(spark.createDataFrame([], "hook string, error string")).first()
    assert (summary.ok, summary.fail, json.loads(summary.errors)) == (0, 0, [])
    lines = spark.createDataFrame([("b", 0, "2"), ("a", 1, "1"), ("a", 0, "0")], "section string, place int, line string")
    sinks.write_lines(lines, str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] and "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))) == "0\n1\n2\n"


def test_slots_and_rollback(spark, tmp_path):
    none = spark.createDataFrame([], "file_id string, total long, last_pass long, last_ts timestamp")
    new = spark.createDataFrame([("a", 2), ("a", 1), (None, 3)], "file_id string, pass_number long").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    assert {(r.file_id, r.total, r.last_pass) for r in snapshots.slots(none, new).collect()} == {("a", 2, 2), (None, 1, 3)}
    root = str(tmp_path)
    snapshots.publish(spark, root, {"t": spark.range(3)}, 1)
    wrong = lambda x: {"t": x["t"].select(F.raise_error(F.lit("while writing")).cast("long").alias("id"))}
    assert snapshots.atomically(spark, root, ["t"], wrong, 2) is not None and snapshots.current(spark, root, "t").count() == 3
    assert snapshots.atomically(spark, root, ["t"], lambda x: {"t": snapshots.clear(x["t"])}, 3) is None and snapshots.current(spark, root, "t").count() == 0


def test_incremental_index(spark):
    schema = "object string, sha string, text string"
    had, have = spark.createDataFrame([("a", "1", "one"), ("b", "1", "two")], schema), spark.createDataFrame([("a", "1", "one"), ("c", "1", "three")], schema)
    index = search.build_index(had, "object", "text", "k").unionByName(search.build_index(had, "object", "text", "other"))
    got = {(r.collection, r.object, r.term) for r in search.incremental(index, had, have, "k").collect()}
    assert got == {("k", "a", "one"), ("k", "c", "three"), ("other", "a", "one"), ("other", "b", "two")}


def test_feed_and_cache(spark):
    feed = cache.Feed(most=1, beat=5)
    assert feed.join("a", 0) and not feed.join("b", 0) and feed.join("a", 0)
    feed.tick(4)
    feed.tick(5)
    feed.leave("a")
    assert feed.join("b", 6) and not feed.clients["b"]
    rows = spark.createDataFrame([(str(i), i) for i in range(7)], "graph_id string, n int")
    graphs = cache.GraphCache(rows, rows, 5)
    for i in (0, 1, 2, 3, 4, 0, 5, 6):
        assert graphs.get(str(i))[0].first().n == i
    assert list(graphs.held) == ["3", "4", "0", "5", "6"]
    graphs.drop("0")
    assert "0" not in graphs.held


def test_flushes_over_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    times = [0.0, 0.3, 0.7, 2.0, 2.6, 3.1, 3.5, 9.0]
    df = spark.createDataFrame([(f"p{i % 2}", "change", t) for i, t in enumerate(times)], "path string, type string, s double").select("path", "type", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    bursts = changes.flushes(df, "500 milliseconds").groupBy("start").count().orderBy("start")
    got = [(round(r.start.timestamp() % 100, 1), r["count"]) for r in bursts.collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == [(0.0, 2), (2.0, 1), (2.6, 2), (9.0, 1)]
    assert changes.flushes(df.limit(0)).collect() == []


def test_numbering_and_schedule(spark):
    jobs = spark.createDataFrame([(3, 1), (1, 5), (2, 5)], "id long, priority long")
    assert [(r.id, r.position, r.wave) for r in changes.scheduled(jobs).orderBy("position").collect()] == [(1, 0, 0), (2, 1, 0), (3, 2, 1)]
    assert changes.scheduled(jobs.limit(0)).collect() == []


def test_checkpoint_folder_is_not_of_the_driver(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda k, d: d)})()

    with pytest.raises(RuntimeError):
        lineage.checkpoint_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        lineage.checkpoint_folder(Session())
