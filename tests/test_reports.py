"""Reports entry by entry, on odd texts."""

from lodestone.functions import reports


def read(kind, text):
    return [(r[2], r[3], r[4]) for r in reports.Entries().eval(kind, text)]


def test_odd_reports():
    assert read("store", None) == read("store", "") == read("none", "--- Store ID: a ---") == []
    assert read("store", "--- Store ID: a ---") == [("a", None, {})]
    assert read("store", "--- Store ID: a ---\nFile:\n  Actions (0): \n  Actions (2): x,, y") == [("a", None, {"actionKeys": []})]
    assert read("file", "1: a.ts\n x: b\n 02:  c d.ts \n3: [COMPARE] e") == [("a.ts", "a.ts", {}), ("c d.ts", "c d.ts", {})]
    assert read("type", "interface No {}\n--- File: a.ts ---\nenum lower {}\nexport type A = enum B\n--- File: b.ts ---") == [("A", "a.ts", {}), ("B", "a.ts", {})]
    assert read("component", "x File Name: A.vue (a/A.vue) y\n  UI Elements (1): n-a\nFile Name: none") == [("A.vue", "a/A.vue", {"uiElements": ["n-a"]})]


def test_an_entry_ends_with_its_characters():
    far = "Command: a\n" + "x" * 296 + "\n    - b.ts and more\n    - c.ts"
    assert read("command", far) == [("a", None, {})]
    near = "Command: a\n" + "x" * 280 + "\n    - b.ts and more\n    - c.ts"
    assert read("command", near) == [("a", None, {"invokedFiles": ["b.ts and mor"]})]
    assert read("command", "Command: a\n  Declared in: x.rs\nCommand: b\n  Invoked in: 1 file(s)") == [("a", "x.rs", {"declaredIn": ["x.rs"]}), ("b", None, {"invokedIn": ["1 file(s)"]})]


def test_first_entry_of_a_name_counts(spark):
    rows = [("p", "route", "- Path: /a\n  Component: X\n- Path: /a\n  Component: Y", 2), ("p", "route", "- Path: /a\n  Component: Z", 1), ("p", "route", None, 0), ("q", "route", "- Path: /a", 5)]
    got = {r.project: r.fields.get("component") for r in reports.entries(spark.createDataFrame(rows, "project string, kind string, text string, n int"), "n").collect()}
    assert got == {"p": ["Z"], "q": None}
    assert reports.entries(spark.createDataFrame([], "project string, kind string, text string")).collect() == []


def test_statements_in_strings_comments_and_templates_are_none(spark):
    from lodestone.functions import source_text as P

    code = r"""
import a from "real-a"; // import b from "comment-b"
const s = "import c from 'string-c'"; const t = 'import(\'string-d\')';
/* import e from "comment-e"; // */ import f from 'real-f';
const u = `import g from "template-g" ${h(`import("nested-h")`)} require("template-i")`;
const r = /import j from "regex-j"['"]/g; const k = require('real-k');
const url = "http://x"; import l from "real-l";
const lazy = import(`./real-m`); const no = `//`; import("real-n");
const open = "unterminated
import o from 'real-o'
/* never closed import p from "p"
"""
    got = sorted(r.specifier for r in P.imports(spark.createDataFrame([("a.js", code)], "path string, text string")).collect())
    assert got == ["./real-m", "real-a", "real-f", "real-k", "real-l", "real-n", "real-o"]


def test_chains_of_exports(spark):
    from lodestone.functions import source_text as P

    reexports = spark.createDataFrame([("a", 0, "x", "y", "b"), ("b", 0, "y", "y", "c"), ("c", 1, "z", "z", "a"), ("l1", 0, "q", "q", "l2"), ("l2", 0, "q", "q", "l1")] + [(f"d{i}", 0, "n", "n", f"d{i + 1}") for i in range(9)], "path string, ordinal int, name string, local string, target string")
    stars = spark.createDataFrame([("s", 0, "c"), ("c", 0, "own")], "path string, ordinal int, target string")
    own = spark.createDataFrame([("own", "y"), ("own", "default")], "path string, name string")
    wanted = spark.createDataFrame([("a", "x"), ("a", "y"), ("s", "y"), ("s", "default"), ("l1", "q"), ("d0", "n"), ("nowhere", "n")], "path string, name string")
    got = {(r.path, r.name): r.chain for r in P.export_chains(wanted, reexports, stars, own).collect()}
    assert got == {("a", "x"): ["a", "b", "c", "own"], ("a", "y"): ["a", "b", "c", "own"], ("s", "y"): ["s", "c", "own"], ("s", "default"): ["s"], ("l1", "q"): ["l1", "l2"], ("d0", "n"): [f"d{i}" for i in range(6)], ("nowhere", "n"): ["nowhere"]}


def test_chains_of_exports_have_no_bound_on_rows(spark):
    from lodestone.functions import source_text as P

    links = spark.range(40).selectExpr("'f' || id as path", "0 as ordinal", "'n' as name", "'n' as local", "'f' || (id + 1) as target")
    bound = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(bound)
    spark.conf.set(bound, 50)
    try:
        found = P.export_chains(links.select("path", "name"), links, links.select("path", "ordinal", "target").limit(0), links.select("path", "name").limit(0))
        got = {r.path: r.chain for r in found.collect()}
    finally:
        spark.conf.set(bound, before)
    assert got == {f"f{i}": [f"f{k}" for k in range(i, min(i + 5, 40) + 1)] for i in range(40)}


def test_rules_are_spelled_out():
    from lodestone.functions import intent_rules as I

    assert I.spelled("schema[-_]?card") == [("schema-card", False), ("schema_card", False), ("schemacard", False)]
    assert I.spelled("types?$") == [("type", True), ("types", True)] and I.spelled("AST") == [("ast", False)] and I.spelled("") == I.spelled("$") == []
    assert I.spelled("better-sqlite3") == [("better-sqlite3", False)]


def test_first_rule_of_odd_names(spark):
    from lodestone.functions import intent_rules as I

    rules = I.rule_table(spark, [("ab", "first"), ("b$", "second"), ("a", "third"), ("", "never"), ("ab", "later")])
    names = spark.createDataFrame([("xABy",), ("cb",), ("bc",), ("A",), ("",), (None,), ("cb",)], "name string")
    assert sorted((r.name, r.output) for r in I.first_rule(names, rules).collect()) == [("A", "third"), ("cb", "second"), ("xABy", "first")]
    assert I.first_rule(names, rules.limit(0)).collect() == []
    nothing = spark.createDataFrame([], "path string, ordinal int, specifier string")
    files = spark.createDataFrame([("a/cli.sh",), ("b/qqq.js",)], "path string")
    got = {r.path: (r.purpose, r.depends_on, r.value) for r in I.intents(files, nothing, nothing.withColumnRenamed("specifier", "name")).collect()}
    assert got["b/qqq.js"] == ("Source module at b/qqq.js ???", "No external dependencies ???", "Internal module with no public exports ???")
    assert got["a/cli.sh"][0] == "Command-line interface ???" and got["a/cli.sh"][2].startswith("Command-line interface for project")
