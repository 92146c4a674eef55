"""Reports of a project read entry by entry: nodes with their fields, and the graph of all reports and source files.

A table function goes through the lines of a report once and carries the entry that it is in: what follows a heading belongs to it, up to the next heading, a rule, or,
in reports whose entries have no end, a number of characters. It yields a row for each entry as soon as that ends, so that of a report of any length it holds one
entry. Everything else is joins: contains, navigates and invokes edges by path and by name.

Rows: null and empty reports have no entries; of entries of one project, kind and name the first counts (by report, then by place); a field without a
value is none; nodes without a path have no file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.source_text import exports, imports

#: The headings of entries by kind of report, as pattern of a line; the labels of their fields, with the names they get; the labels of lists that
#: have a number behind them; and how many characters behind a heading belong to its entry, where nothing else ends it.
HEADINGS = {
    "file": r"\s*\d+:\s+(?P<name>.+)",
    "store": r"--- Store ID:\s*(?P<name>.+?)\s*---",
    "route": r"\s*-\s*Path:\s*(?P<name>.+)",
    "command": r"Command:\s*(?P<name>.+)",
    "type": r"--- File:\s*(?P<name>.+?)\s*---",
    "component": r".*?File Name:\s*(?P<name>.+?)\s*\((?P<path>[^)]+)\).*",
}
LABELS = {
    "store": {"File": "file", "Exported As": "exportedAs", "Type": "storeType"},
    "route": {"Name": "name", "Component": "component"},
    "command": {"Invoked in": "invokedIn", "Declared in": "declaredIn"},
}
LISTS = {"store": {"State Properties": "stateKeys", "Getters": "getterKeys", "Actions": "actionKeys"}, "component": {"UI Elements": "uiElements"}}
REACH = {"route": 200, "command": 300, "component": 300}
COMPARED, NO_KEYS, DYNAMIC = "[COMPARE]", "None", "(Dynamic Import)"

ENTRY = "place int, node_type string, name string, path string, fields map<string,array<string>>"
#: File extensions whose imports and exports are read.
SOURCES = (".ts", ".tsx", ".js", ".jsx", ".vue")


class Entries:
    """place, node_type, name, path, fields of the entries of a report of a kind."""

    def eval(self, kind: str, text: str) -> Iterator[tuple]:
        if text is None or kind not in HEADINGS:
            return
        heading, reach = re.compile(HEADINGS[kind]), REACH.get(kind)
        place, entry, left, at = 0, None, 0, 0
        body: list[str] = []
        while at <= len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line, at = text[at:end], end + 1
            found = heading.fullmatch(line)
            if found or line.startswith(("---", "===")):
                if entry is not None:
                    for row in self._rows(kind, entry, body):
                        yield (place, *row)
                        place += 1
                entry, body, left = found, [], reach
                if found and kind in ("route", "command", "component"):
                    left = reach - 1  # the end of the heading's line
            elif entry is not None and (left is None or left > 0):
                body.append(line if left is None else line[:left])
                left = None if left is None else left - len(line) - 1
        if entry is not None:
            for row in self._rows(kind, entry, body):
                yield (place, *row)
                place += 1

    def _rows(self, kind: str, entry: re.Match, body: list[str]) -> Iterator[tuple]:
        name = entry["name"].strip()
        fields: dict[str, list[str]] = {}
        for line in body:
            label, colon, value = (x.strip() for x in line.partition(":"))
            known = LABELS.get(kind, {}).get(label)
            if known and colon and value:
                fields.setdefault(known, [value])
            numbered = re.fullmatch(r"(.+?)\s*\(\d+\)", label)
            known = LISTS.get(kind, {}).get(numbered[1]) if numbered else None
            if known and known not in fields:
                fields[known] = [] if value == NO_KEYS else [x for x in map(str.strip, value.split(",")) if x]
            if kind == "command" and (item := re.fullmatch(r"\s+-\s+(.+)", line)):
                fields.setdefault("invokedFiles", []).append(item[1].strip())
        if kind == "file":
            if not name.startswith(COMPARED):
                yield kind, name, name, fields
        elif kind == "store":
            yield kind, name, (fields.pop("file", None) or [None])[0], fields
        elif kind == "route":
            yield kind, (fields.pop("name", None) or [name])[0], name, fields
        elif kind == "command":
            yield kind, name, (fields.get("declaredIn") or [None])[0], fields
        elif kind == "component":
            yield kind, name, entry["path"].strip(), fields
        else:
            for line in body:
                words = re.findall(r"\w+", line)
                for word, next_ in zip(words, words[1:]):
                    if word in ("interface", "type", "enum") and re.match("[A-Z][A-Za-z0-9_]*", next_):
                        yield kind, re.match("[A-Z][A-Za-z0-9_]*", next_)[0], name, fields


_entries = F.udtf(Entries, returnType=ENTRY)


def entries(reports: DataFrame, order: str | None = None) -> DataFrame:
    """project, node_type, name, path, fields of reports (project, kind, text), the first of each name; order: a column that reports are ordered by."""
    rows = reports.select("project", F.col("kind").alias("_kind"), F.col("text").alias("_text"), (F.col(order) if order else F.xxhash64("text")).alias("_order"))
    read = rows.lateralJoin(_entries(F.col("_kind").outer(), F.col("_text").outer()))
    first = F.min_by(F.struct("path", "fields"), F.struct("_order", "place"))
    return read.groupBy("project", "node_type", "name").agg(first.alias("_x")).select("project", "node_type", "name", "_x.path", "_x.fields")


def source_nodes(files: DataFrame, entry_points: Column | None = None) -> DataFrame:
    """project, node_type (import, export), name, path, fields of source files (project, path, text): imports by specifier, with kind and file; exports by name,
    with kind, whether they are of an entry point (array of paths), and how often what is named like them is imported."""
    own = files.where(F.lower(F.regexp_extract("path", r"\.\w+$", 0)).isin(*SOURCES)).withColumn("_key", F.to_json(F.struct("project", "path")))
    keys = own.select("_key", "project", "path")
    read = own.select(F.col("_key").alias("path"), "text")
    taken = imports(read).withColumnRenamed("path", "_key").join(keys, "_key")
    given = exports(read).withColumnRenamed("path", "_key").join(keys, "_key")
    one = lambda x: F.array(x.cast("string"))
    first = taken.groupBy("project", F.col("specifier").alias("name")).agg(F.min_by(F.struct("kind", "path"), F.struct("path", "ordinal")).alias("_x"))
    sources = first.select("project", F.lit("import").alias("node_type"), "name", F.col("name").alias("path"), F.create_map(F.lit("importType"), one(F.col("_x.kind")), F.lit("sourceFile"), one(F.col("_x.path"))).alias("fields"))
    words = taken.select("project", F.explode(F.array_distinct(F.split("specifier", r"[^\w$]+"))).alias("name")).where("name <> ''").groupBy("project", "name").agg(F.count("*").alias("_weight"))
    public = F.lit(False) if entry_points is None else F.array_contains(entry_points, F.col("path"))
    named = given.groupBy("project", "name").agg(F.min_by(F.struct("kind", "path"), "path").alias("_x")).join(words, ["project", "name"], "left").select("project", "name", "_x.kind", "_x.path", F.coalesce("_weight", F.lit(0)).alias("_weight"))
    fields = F.create_map(F.lit("kind"), one(F.col("kind")), F.lit("isPublicAPI"), one(public), F.lit("dependencyWeight"), one(F.col("_weight")))
    return sources.unionByName(named.select("project", F.lit("export").alias("node_type"), "name", "path", fields.alias("fields")))


def report_edges(nodes: DataFrame) -> DataFrame:
    """project, source, target (struct of node_type and name), edge_type, confidence between nodes of entries(): files contain the stores, types and components
    at their path, routes navigate to the component of their name, files invoke the commands that list them."""
    node = F.struct("node_type", "name")
    files = nodes.where("node_type = 'file'").select("project", "path", node.alias("source"))
    held = nodes.where(F.col("node_type").isin("store", "type", "component") & F.col("path").isNotNull()).select("project", "path", node.alias("target"))
    contains = files.join(held, ["project", "path"]).select("project", "source", "target", F.lit("contains").alias("edge_type"), F.lit(1.0).alias("confidence"))
    shown = nodes.where("node_type = 'component'").select("project", F.regexp_replace("name", r"\.vue$", "").alias("_shown"), node.alias("target"))
    shown = shown.withColumn("_k", F.row_number().over(Window.partitionBy("project", "_shown").orderBy("target"))).where("_k = 1").drop("_k")
    routes = nodes.where("node_type = 'route'").select("project", node.alias("source"), F.get(F.col("fields")["component"], F.lit(0)).alias("_shown")).where(F.col("_shown") != DYNAMIC)
    navigates = routes.join(shown, ["project", "_shown"]).select("project", "source", "target", F.lit("navigates_to").alias("edge_type"), F.lit(0.9).alias("confidence"))
    calls = nodes.where("node_type = 'command'").select("project", node.alias("target"), F.explode(F.array_distinct(F.col("fields")["invokedFiles"])).alias("path"))
    invokes = files.join(calls, ["project", "path"]).select("project", "source", "target", F.lit("invokes").alias("edge_type"), F.lit(0.95).alias("confidence"))
    return contains.unionByName(navigates).unionByName(invokes)

