"""Imports, exports and other facts read from source text by regular expressions, all in the JVM."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import settled

_Q = r"""['"`]([^'"`]+)['"`]"""


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def script_of(text: Column, path: Column) -> Column:
    """The script blocks of a single-file component, else the text."""
    return F.when(path.endswith(".vue"), F.array_join(_all(text, r"(?s)<script[^>]*>(.*?)</script>"), "\n")).otherwise(text)


#: What is not code, in one pattern, so that each sign is read as part of what it stands in: short strings and templates without blanks, quotes and
#: expressions, which may name a module, are kept by its group; all else goes: comments, other strings, templates with what is in them, regular expressions.
_TOKENS = (
    r"""("[^"'`\\\s]*"|'[^"'`\\\s]*'|`[^"'`\\\s${}]*`)"""
    r"""|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)"""
    r"""|"(?:\\(?s:.)|[^"\\\n])*+(?:"|$)|'(?:\\(?s:.)|[^'\\\n])*+(?:'|$)"""
    r"""|`(?:\\(?s:.)|\$\{(?:[^{}`]|`(?:\\(?s:.)|[^`\\])*+`|\{[^{}]*\})*+\}|[^`\\])*+`"""
    r"""|(?<=[(=,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*"""
)


def code_of(text: Column) -> Column:
    """Source text without comments, and without strings, templates and regular expressions that cannot be the name of a module: what is left of a statement is code.

    One pass of one pattern; a template may hold expressions with templates and braces in them, one level deep. Lines stay where they are, but for those
    within comments and templates.
    """
    return F.regexp_replace(text, "(?m)" + _TOKENS, "$1")


def without_comments(text: Column) -> Column:
    """As code_of()."""
    return code_of(text)


#: What a line adds to the two complexities: a pattern, whether it adds one to the number of ways, and to the effort of reading: nothing, one, or one
#: more than the depth it stands at.
COUNTED = (
    (r"\b(?:if|else if|\?\s*)\b", True, "deep"),
    (r"\b(?:for|while|do)\b", True, "deep"),
    (r"\bswitch\b", True, "deep"),
    (r"\bcase\b", True, None),
    (r"\bcatch\b", True, "deep"),
    (r"&&|\|\|", True, "flat"),
)


def complexity(code: Column) -> Column:
    """struct(cyclomatic, cognitive, lines) of a piece of code, line by line; the depth is that of braces open at the start of a line. Null for null."""
    count = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    hits = lambda line, wanted: functools.reduce(lambda a, b: a + b, (F.when(line.rlike(p), 1).otherwise(0) for p, ways, effort in COUNTED if wanted(ways, effort)))

    def of(line: Column) -> Column:
        return F.struct(hits(line, lambda w, _: w).alias("ways"), hits(line, lambda _, e: e == "deep").alias("deep"), hits(line, lambda _, e: e == "flat").alias("flat"), (count(line, "{") - count(line, "}")).alias("opens"))

    def add(s: Column, x: Column) -> Column:
        effort = s["cognitive"] + x["deep"] * (1 + s["depth"]) + x["flat"]
        return F.struct((s["cyclomatic"] + x["ways"]).alias("cyclomatic"), effort.alias("cognitive"), (s["lines"] + 1).alias("lines"), F.greatest(F.lit(0), s["depth"] + x["opens"]).alias("depth"))

    start = F.struct(F.lit(1).alias("cyclomatic"), F.lit(0).alias("cognitive"), F.lit(0).alias("lines"), F.lit(0).alias("depth"))
    out = F.aggregate(F.transform(F.split(code, "\n", -1), of), start, add)
    return F.when(code.isNotNull(), F.struct(out["cyclomatic"].alias("cyclomatic"), out["cognitive"].alias("cognitive"), out["lines"].alias("lines")))


#: Kind of import, pattern with the specifier in the last group, group of the names (0: none).
IMPORTS = (
    ("default", r"\bimport\s+(?:type\s+)?([A-Za-z_$][\w$]*)\s+from\s+" + _Q, 2, 1),
    ("default", r"\bimport\s+([A-Za-z_$][\w$]*)\s*,\s*[{*][^;'\"]*\bfrom\s+" + _Q, 2, 1),
    ("named", r"\bimport\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s+" + _Q, 2, 1),
    ("namespace", r"\bimport\s+(?:[\w$]+\s*,\s*)?\*\s+as\s+([\w$]+)\s+from\s+" + _Q, 2, 1),
    ("side-effect", r"\bimport\s+" + _Q, 1, 0),
    ("dynamic", r"\bimport\s*\(\s*" + _Q + r"\s*\)", 1, 0),
    ("require", r"\brequire\s*\(\s*" + _Q + r"\s*\)", 1, 0),
    ("reexport", r"\bexport\s+\{[^}]*\}\s*from\s+" + _Q, 1, 0),
    ("star", r"\bexport\s+\*(?:\s+as\s+[\w$]+)?\s+from\s+" + _Q, 1, 0),
)


def _tagged(kind: str, pairs: Column) -> Column:
    return F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("specifier"), x["n"].alias("names")))


def imports(files: DataFrame) -> DataFrame:
    """path, ordinal, kind, specifier, names (as written) of files (path, text)."""
    text = without_comments(script_of(F.col("text"), F.col("path")))
    found = []
    for kind, pattern, spec, names in IMPORTS:
        named = _all(text, pattern, names) if names else F.transform(_all(text, pattern, spec), lambda x: F.lit(""))
        found.append(_tagged(kind, F.arrays_zip(_all(text, pattern, spec).alias("s"), named.alias("n"))))
    return files.select("path", F.posexplode(F.concat(*found)).alias("ordinal", "_x")).select("path", "ordinal", "_x.*")


def exports(files: DataFrame) -> DataFrame:
    """path, name, kind (declaration, named, default, commonjs) of files (path, text); a name counts once."""
    text = without_comments(script_of(F.col("text"), F.col("path")))
    one = lambda names, kind: F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(kind).alias("kind")))
    lists = lambda pattern: F.filter(F.transform(F.flatten(F.transform(_all(text, pattern), lambda x: F.split(x, ","))), lambda x: F.regexp_extract(F.trim(x), r"(?:.*\bas\s+)?([\w$]+)", 1)), lambda x: x != "")
    declared = _all(text, r"\bexport\s+(?:async\s+)?(?:const|let|var|function\*?|class|interface|type|enum)\s+([\w$]+)")
    default = F.transform(_all(text, r"\bexport\s+default\s+(?:async\s+)?(?:(?:function\*?|class)\s+)?([\w$]*)"), lambda x: F.when(x.isin("", "function", "class", "async"), "default").otherwise(x))
    assigned = F.filter(_all(text, r"\bmodule\.exports\s*=\s*([A-Za-z_$][\w$]*)"), lambda x: ~x.isin("function", "class", "async", "require", "new"))
    objects = F.filter(F.transform(F.flatten(F.transform(_all(text, r"\bmodule\.exports\s*=\s*\{([^{}]*)\}"), lambda x: F.split(x, ","))), lambda x: F.regexp_extract(F.trim(x), r"^([\w$]+)", 1)), lambda x: x != "")
    every = F.concat(one(declared, "declaration"), one(lists(r"\bexport\s+(?:type\s+)?\{([^}]*)\}"), "named"), one(default, "default"), one(assigned, "default"), one(objects, "commonjs"), one(_all(text, r"(?<!module\.)(?<![\w$])exports\.([\w$]+)\s*="), "commonjs"), one(_all(text, r"\bmodule\.exports\.([\w$]+)\s*="), "commonjs"))
    ranked = files.select("path", F.posexplode(every).alias("_i", "_x"))
    return ranked.groupBy("path", "_x.name").agg(F.min_by("_x.kind", "_i").alias("kind"))


def star_closure(stars: DataFrame, own: DataFrame, depth: int = 3) -> DataFrame:
    """path, name: exports of each path, those of the files that it re-exports whole included, to a depth.

    stars: path, target; own: path, name.
    """
    steps, known = stars.select("path", "target"), own.select("path", "name")
    level = known
    for _ in range(depth):
        level = steps.join(level.withColumnRenamed("path", "target"), "target").where("name <> 'default'").select("path", "name").distinct()
        known = known.union(level)
    return known.distinct()


def export_chains(wanted: DataFrame, reexports: DataFrame, stars: DataFrame, own: DataFrame, depth: int = 5) -> DataFrame:
    """path, name, chain (array of paths): through which files an export comes, from the file that is asked to the one that makes it.

    wanted: path, name. reexports: path, ordinal, name (as exported), local (its name in target), target. stars: path, ordinal, target (all of whose exports are
    exported on). own: path, name. A file hands a name on by its first statement that does; a chain ends where no statement does, after depth + 1 files, or
    before a file that it has been at. All chains are followed at once, a join a step: a recursive query has a bound on its rows (cteRecursionRowLimit).
    """
    there = star_closure(stars, own.unionByName(reexports.select("path", "name")))
    from_stars = stars.join(there.withColumnRenamed("path", "target"), "target").select("path", "ordinal", "target", "name", F.col("name").alias("local"))
    named = reexports.select("path", "ordinal", "target", F.explode(F.array_distinct(F.array("name", "local"))).alias("name"), "local")
    steps = settled(named.unionByName(from_stars).groupBy("path", "name").agg(F.min_by(F.struct("target", "local"), "ordinal").alias("_x")).select("path", "name", "_x.target", "_x.local"))
    level = wanted.select("path", "name").distinct().withColumns({"at": F.col("path"), "called": F.col("name"), "chain": F.array("path")})
    walk = level
    keys = steps.toDF("at", "called", "_target", "_local")
    for _ in range(depth):
        further = level.join(keys, ["at", "called"]).where(~F.array_contains("chain", F.col("_target")))
        level = settled(further.select("path", "name", F.col("_target").alias("at"), F.col("_local").alias("called"), F.array_append("chain", F.col("_target")).alias("chain")))
        walk = walk.unionByName(level)
    return walk.groupBy("path", "name").agg(F.max_by("chain", F.size("chain")).alias("chain"))


def commands_invoked(text: Column) -> Column:
    return F.array_distinct(_all(text, r"\binvoke(?:<[^>]*>)?\(\s*" + _Q))


def commands_declared(text: Column) -> Column:
    return F.array_distinct(_all(text, r"#\[(?:tauri::)?command[^\]]*\]\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"))


def ui_tags(text: Column, pattern: str = r"<(n-[a-z0-9-]+)") -> Column:
    return F.array_distinct(_all(text, pattern))


def doc_tags(text: Column) -> Column:
    """tag -> text of the tags in documentation comments; the first of a name wins."""
    pairs = F.arrays_zip(_all(text, r"(?m)^\s*\*\s*@(\w+)[ \t]*(.*?)\s*$", 1).alias("k"), _all(text, r"(?m)^\s*\*\s*@(\w+)[ \t]*(.*?)\s*$", 2).alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))


def is_pure(text: Column) -> Column:
    """No sign of input, output, time, chance or shared state."""
    return ~text.rlike(r"\b(console|fetch|localStorage|document|window|process|fs|Math\.random|Date\.now|setTimeout|setInterval)\b|\bthis\.|\bawait\b")


def _after(line: Column, mark: str) -> Column:
    """What follows a mark at the start of a line, trimmed; null without the mark."""
    return F.when(line.startswith(mark), F.trim(F.substring(line, F.lit(len(mark) + 1), F.length(line))))


def _listed(kind: str, line: Column) -> Column:
    """struct(name, path) of the node that a trimmed line of a report of a kind lists, else null."""
    path = F.lit(None).cast("string")
    if kind == "file":  # 12: path
        name = F.when(F.substring_index(line, ":", 1).rlike("^[0-9]+$") & line.contains(":"), F.trim(F.substring(line, F.length(F.substring_index(line, ":", 1)) + 2, F.length(line))))
        path = name
    elif kind == "store":
        name = F.when(line.endswith("---"), F.trim(F.regexp_replace(_after(line, "--- Store ID:"), "-+$", "")))
    elif kind == "route":
        name = path = _after(F.regexp_replace(line, r"^-\s*", "- "), "- Path:")
    elif kind == "command":
        name = _after(line, "Command:")
    else:  # File Name: name (path)
        rest = F.when(line.contains("File Name:") & line.contains("("), F.substring_index(line, "File Name:", -1))
        name, path = F.trim(F.substring_index(rest, "(", 1)), F.trim(F.substring_index(F.substring_index(rest, "(", -1), ")", 1))
    return F.when(F.length(name) > 0, F.struct(name.alias("name"), path.alias("path")))


#: Kinds of nodes that reports list line by line.
REPORTS = ("file", "store", "route", "command", "component")


def report_nodes(reports: DataFrame, kind: str) -> DataFrame:
    """project, node_type, name, path of the nodes that a report (project, text) lists; a name counts once, of the first line with it."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: _listed(kind, F.trim(x)))
    rows = reports.select("project", F.posexplode(lines).alias("_i", "_x")).where(F.col("_x").isNotNull() & ~F.col("_x.name").startswith("[COMPARE]"))
    return rows.groupBy("project", "_x.name").agg(F.min_by("_x.path", "_i").alias("path")).select("project", F.lit(kind).alias("node_type"), "name", "path")


def _declared(line: Column) -> Column:
    """The name that a line declares as a type: the word behind interface, type or enum, with a capital first."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: ~w.isin("export", "declare", "const", "default"))
    name = F.regexp_extract(F.coalesce(F.get(words, F.lit(1)), F.lit("")), r"^\w+", 0)
    return F.when(F.get(words, F.lit(0)).isin("interface", "type", "enum") & name.rlike("^[A-Z]"), name)


def report_types(reports: DataFrame) -> DataFrame:
    """Like report_nodes() for the types declared in the blocks of a type report, each headed by its file."""
    blocks = F.slice(F.split(F.concat(F.lit("\n"), "text"), "\n--- File:", -1), 2, 1 << 30)
    heads = reports.select("project", F.explode(blocks).alias("block")).select("project", F.trim(F.substring_index("block", "---", 1)).alias("path"), F.substring_index("block", "\n===", 1).alias("body"))
    names = heads.select("project", "path", F.explode(F.array_compact(F.transform(F.split("body", "\n"), _declared))).alias("name"))
    return names.groupBy("project", "name").agg(F.min("path").alias("path")).select("project", F.lit("type").alias("node_type"), "name", "path")


def ingest(reports: DataFrame) -> DataFrame:
    """All nodes of reports (project, kind, text), of one project or several."""
    out = report_types(reports.where("kind = 'type'"))
    for kind in REPORTS:
        out = out.unionByName(report_nodes(reports.where(F.col("kind") == kind), kind))
    return out


def ingest_with(reports: DataFrame, parsers: Mapping[str, Callable[[DataFrame], DataFrame]], fallback: Callable[[DataFrame, str], DataFrame], retries: int = 2, most_failures: int = 3) -> tuple[DataFrame, dict[str, str]]:
    """Nodes of reports (project, kind, text) by a parser a kind, and how each kind went: parsed, retried, fallback, or skipped.

    A parser's result is written before it counts, so that its failures show here. It is tried again retries times, then the fallback reads the
    kind. After most_failures kinds failed the circuit is open: the kinds left go to the fallback at once.
    """
    parts, went, failed = [], {}, 0
    for kind, parse in parsers.items():
        rows = reports.where(F.col("kind") == kind)
        for attempt in range(retries + 1 if failed < most_failures else 0):
            try:
                parts.append(settled(parse(rows)))
                went[kind] = "retried" if attempt else "parsed"
                break
            except Exception:  # whatever a caller's parser raises
                continue
        else:
            failed += 1
            went[kind] = "fallback" if failed <= most_failures else "skipped"
            parts.append(settled(fallback(rows, kind)))
    return functools.reduce(DataFrame.unionByName, parts), went
