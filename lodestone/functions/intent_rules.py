"""Purposes, dependencies and values of files by rules over names: rules are rows, the first that holds wins.

A rule's pattern is one word, or a few that differ in a mark between their parts or in a last letter; it is spelled out into plain words, and one that must stand
at the end of a name is marked so. A name gives all its parts of the lengths that the rules' words have; names and rules meet in an equi-join by part, and the smallest
rank of a name wins. The work is in proportion to the lengths of names, not to the number of rules, which may come from a table of any size.

Rows: a null name has no rule; case does not count; a rule of an empty pattern holds nowhere; ranks that tie give the smaller output.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

#: Up to this many spelled-out rules are broadcast.
FEW_RULES = 100_000
#: What a file is for by its name, what importing a module is for, and what an exported name gives, in order of precedence.
PURPOSES = (
    ("persistence", "SQLite persistence layer"),
    ("server", "HTTP server and API routes"),
    ("indexer", "Codebase indexing and analysis"),
    ("types?$", "Type definitions and constants"),
    ("schema[-_]?card", "Schema card emission"),
    ("emitter", "Event or data emission"),
    ("watcher", "File system change monitoring"),
    ("generator", "Code or data generation"),
    ("printer", "Output formatting and display"),
    ("notification", "Event notification system"),
    ("manifest", "Project manifest generation"),
    ("config", "Configuration management"),
    ("util", "Utility functions"),
    ("helper", "Helper functions"),
    ("test", "Test suite"),
    ("index", "Module entry point"),
    ("main", "Application entry point"),
    ("app", "Application core"),
    ("cli", "Command-line interface"),
    ("db", "Database operations"),
    ("graph[-_]?builder", "Dependency graph construction"),
    ("graph[-_]?traversal", "Graph traversal and querying"),
    ("graph[-_]?visual", "Graph visualization"),
    ("insight[-_]?store", "Insight storage and retrieval"),
    ("database[-_]?persister", "Database persistence operations"),
    ("relationship[-_]?analy", "Code relationship analysis"),
    ("toml[-_]?serial", "TOML serialization"),
    ("ast[-_]?parser", "AST parsing and analysis"),
    ("ast", "AST parsing"),
    ("io[-_]?chan", "I/O channel abstraction"),
    ("safe[-_]?fs", "Safe file system operations"),
    ("coordination", "Process coordination"),
    ("settings", "Settings management"),
    ("void[-_]?engine", "Rendering engine"),
    ("terminal", "Terminal interface"),
    ("fake[-_]?stream", "Stream mocking utility"),
    ("file[-_]?explorer", "File explorer UI"),
    ("explorer", "File explorer UI"),
    ("visuali", "Data visualization"),
    ("overview", "Project overview display"),
    ("parser", "Parsing utilities"),
    ("background", "Background processing"),
    ("migration", "Database migration"),
    ("path[-_]?gen", "Path generation"),
    ("report", "Report generation"),
    ("data[-_]?ingest", "Data ingestion pipeline"),
    ("ingest", "Data ingestion"),
    ("ground[-_]?plane", "Ground plane abstraction"),
    ("plane", "Spatial plane abstraction"),
    ("verify", "Verification and testing"),
    ("gap[-_]?analy", "Gap analysis"),
    ("analy", "Analysis module"),
    ("prd", "Product Requirements Document"),
    ("seeder", "Data seeding"),
    ("press[-_]?release", "Press Release"),
    ("gtm[-_]?plan", "Go-To-Market Plan"),
    ("stakeholder", "Stakeholder Registry"),
    ("technical[-_]?spec", "Technical Specification"),
    ("roadmap", "Project Roadmap"),
    ("meeting[-_]?notes", "Meeting Notes"),
    ("decision[-_]?log", "Decision Log"),
    ("risk[-_]?register", "Risk Register"),
    ("user[-_]?story", "User Story"),
    ("acceptance[-_]?criteria", "Acceptance Criteria"),
    ("changelog", "Change Log"),
    ("readme", "Project README"),
    ("todo", "Todo List"),
    ("bug[-_]?report", "Bug Report"),
    ("feature[-_]?request", "Feature Request"),)
BEHAVIOURS = (
    ("better-sqlite3", "SQLite database engine"),
    ("chokidar", "file system watching"),
    ("express", "HTTP request handling"),
    ("path", "file path manipulation"),
    ("fs", "file system operations"),
    ("crypto", "cryptographic hashing"),
    ("persistence", "database persistence layer"),
    ("indexer", "codebase indexing"),
    ("schema[-_]?card", "schema card management"),
    ("ast", "AST parsing"),
    ("graph", "dependency graph building"),
)
VALUES = (
    ("persistence", "CRUD operations for file registry"),
    ("server", "HTTP API endpoints"),
    ("index", "codebase indexing pipeline"),
    ("emitter", "schema card emission"),
    ("types?$", "shared type definitions"),
    ("watcher", "file change monitoring"),
    ("generator", "automated code generation"),
    ("printer", "formatted output"),
)
#: What is said without a rule, and the mark of a guess.
GUESS, NO_IMPORTS, NO_EXPORTS, COMMANDS = " ???", "No external dependencies", "Internal module with no public exports", "Command-line interface for {product} operations"


def spelled(pattern: str) -> list[tuple[str, bool]]:
    """The plain words of a pattern, each with whether it must end the name: [..]? is one of its marks or none, x? a letter or none, $ the end."""
    ends = pattern.endswith("$")
    parts = re.findall(r"\[([^\]]+)\](\??)|(.)(\??)", pattern.removesuffix("$").lower())
    choices = [[*(marks or letter), *([""] if maybe or perhaps else [])] for marks, maybe, letter, perhaps in parts]
    return sorted({("".join(c), ends) for c in itertools.product(*choices)} - {("", ends)})


def rule_table(spark: SparkSession, rules, ranks: int = 0) -> DataFrame:
    """word, ends, rank, output of rules (pattern, output), in order."""
    rows = [(w, e, ranks + i, out) for i, (pattern, out) in enumerate(rules) for w, e in spelled(pattern)]
    return spark.createDataFrame(rows, "word string, ends boolean, rank int, output string")


def first_rule(names: DataFrame, rules: DataFrame) -> DataFrame:
    """name, rank, output of the names (name) that a rule (word, ends, rank, output) holds for, the first rule of each."""
    lengths = [r[0] for r in rules.select(F.length("word").alias("n")).distinct().orderBy("n").collect()]  # lengths of words: few
    low = F.lower("name")
    part = lambda n: F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))
    parts = F.array_distinct(F.flatten(F.array(F.array().cast("array<string>"), *(F.when(F.length(low) >= n, part(n)).otherwise(F.array().cast("array<string>")) for n in lengths if n))))
    each = names.select("name").where(F.col("name").isNotNull()).distinct().select("name", F.explode(parts).alias("word"))
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    met = each.join(broadcast(rules) if few else rules, "word").where(~F.col("ends") | F.lower("name").endswith(F.col("word")))
    return met.groupBy("name").agg(F.min(F.struct("rank", "output")).alias("x")).select("name", "x.rank", "x.output")


def intents(files: DataFrame, imports: DataFrame, exports: DataFrame, comments: DataFrame | None = None, product: str = "project", tables: tuple | None = None) -> DataFrame:
    """path, purpose, depends_on, value of files (path), by the names of files, of what they import (path, ordinal, specifier) and export (path, ordinal,
    name), and by their first comments (path, comment): guesses, marked so.

    purpose: by the file's name, then its first comment if that has 11 to 99 characters; without both by its first import that has a rule, and by its first export that has one.
    depends_on: of each import its rule, or the last part of its name; value: of each export its rule, or its name; each once, in order.
    """
    spark = files.sparkSession
    by_name, by_import, by_export = tables or (rule_table(spark, r) for r in (PURPOSES, BEHAVIOURS, VALUES))
    base = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    named = files.select("path", base.alias("name"))
    found = named.join(first_rule(named, by_name), "name").select("path", F.col("output").alias("_named"))
    # each output once, at its first place; outputs of a file are as many as it imports or exports
    listed = lambda df: df.groupBy("path", "said").agg(F.min("ordinal").alias("_o"), F.bool_or("ruled").alias("_ruled")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_o", "said", "_ruled"))).alias("all"))
    took = imports.select("path", "ordinal", F.col("specifier").alias("name"))
    took = took.join(first_rule(took, by_import), "name", "left")
    module = F.regexp_replace(F.regexp_extract("name", "[^/]*$", 0), r"\.(js|ts)$", "")
    depends = listed(took.select("path", "ordinal", F.coalesce("output", module).alias("said"), F.col("output").isNotNull().alias("ruled"))).withColumnRenamed("all", "_imports")
    gave = exports.select("path", "ordinal", "name")
    gave = gave.join(first_rule(gave, by_export), "name", "left")
    values = listed(gave.select("path", "ordinal", F.coalesce("output", F.concat("name", F.lit(" API"))).alias("said"), F.col("output").isNotNull().alias("ruled"))).withColumnRenamed("all", "_exports")
    df = files.select("path").distinct().join(found, "path", "left").join(depends, "path", "left").join(values, "path", "left")
    said = F.lit(None).cast("string")
    if comments is not None:
        df = df.join(comments.groupBy("path").agg(F.first("comment").alias("_comment")), "path", "left")
        said = F.when(F.length("_comment").between(11, 99), F.col("_comment"))
    ruled = lambda c: F.get(F.filter(c, lambda x: x["_ruled"]), F.lit(0))["said"]
    told = F.nullif(F.concat_ws(" — ", F.col("_named"), said), F.lit(""))
    purpose = F.coalesce(told, F.concat(F.lit("Uses "), ruled("_imports")), F.concat(F.lit("Provides "), ruled("_exports")), F.concat(F.lit("Source module at "), "path"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["said"]), ", ")
    nothing = F.when(F.col("path").contains("cli"), COMMANDS.format(product=product)).otherwise(NO_EXPORTS)
    value = F.coalesce(F.concat(F.lit("Provides "), joined("_exports")), nothing)
    mark = lambda c: F.concat(c, F.lit(GUESS))
    return df.select("path", mark(purpose).alias("purpose"), mark(F.coalesce(joined("_imports"), F.lit(NO_IMPORTS))).alias("depends_on"), mark(value).alias("value"))
