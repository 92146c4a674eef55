"""Manifests, cards, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import relations


def manifest(registry: DataFrame, connections: DataFrame) -> DataFrame:
    """One JSON document a file: its fields, whom it imports (with paths) and who imports it."""
    names = registry.select(F.col("fingerprint").alias("target"), F.col("filepath").alias("target_path"))
    out = connections.join(names, "target", "left").groupBy(F.col("source").alias("fingerprint")).agg(F.array_sort(F.collect_list(F.struct("specifier", "target_path"))).alias("imports"))
    into = relations.imported_by(connections, registry).select(F.col("target").alias("fingerprint"), F.col("importers").alias("importedBy"))
    df = registry.join(out, "fingerprint", "left").join(into, "fingerprint", "left")
    empty = F.array()
    fields = [c for c in registry.columns if c != "fingerprint"]
    doc = F.to_json(F.struct("fingerprint", *sorted(fields), F.coalesce("imports", empty.cast("array<struct<specifier:string,target_path:string>>")).alias("imports"), F.coalesce("importedBy", empty.cast("array<string>")).alias("importedBy")))
    return df.select("fingerprint", doc.alias("json"))


def toml_lines(registry: DataFrame) -> DataFrame:
    """filepath, toml: one [[file]] block each; a file can be archived if it is RED and nothing depends on it."""
    archive = F.when((F.col("status") == "RED") & (F.col("impact") == 0), "true").otherwise("false")
    block = F.concat(F.lit('[[file]]\npath = "'), scalars.escape_toml(F.col("filepath")), F.lit('"\nstatus = "'), "status", F.lit('"\ncan_be_archived = '), archive, F.lit("\n"))
    return registry.select("filepath", block.alias("toml"))


def write_cards(df: DataFrame, folder: str) -> None:
    """Cards as JSON lines with sorted keys, one row a file; a stale card is gone with the snapshot it belonged to."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(folder)


def keep_newest(files: DataFrame, n: int = 10) -> DataFrame:
    """The n last names of every base name (what stands before the first dot)."""
    base = F.substring_index("name", ".", 1)
    return files.withColumn("_k", F.row_number().over(Window.partitionBy(base).orderBy(F.desc("name")))).where(F.col("_k") <= n).drop("_k")


def assign_ids(nodes: DataFrame, edges: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """nodes with numeric node_id, and edges (src, dst by key) with numeric ends; edges with an unknown end go.

    Ids follow the order of keys: partition counts first, then a place within each, so no task sees all rows.
    """
    spark = nodes.sparkSession
    ordered = nodes.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), key).sortWithinPartitions(key)
    from lodestone.operators.lineage import cut

    placed = cut(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_first")).orderBy("_p").collect()  # a row a partition
    before, rows = 0, []
    for r in sizes:
        rows.append((r["_p"], before - r["_first"]))
        before += r["n"]
    shift = spark.createDataFrame(rows or [(0, 0)], "_p int, _shift long")
    numbered = placed.join(F.broadcast(shift), "_p").withColumn("node_id", F.col("_m") + F.col("_shift") + 1).drop("_p", "_m", "_shift")
    ids = numbered.select(key, "node_id")
    out = edges.join(ids.select(F.col(key).alias("src"), F.col("node_id").alias("_a")), "src").join(ids.select(F.col(key).alias("dst"), F.col("node_id").alias("_b")), "dst")
    return numbered, out.drop("src", "dst").withColumnsRenamed({"_a": "src", "_b": "dst"})


def markdown_table(df: DataFrame, limit: int = 20) -> str:
    """A report's table: the first rows, and how many more there are."""
    rows = df.limit(limit + 1).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    body = "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows[:limit])
    return head + body + (f"\n… {df.count() - limit} more\n" if len(rows) > limit else "")


def context_lines(registry: DataFrame) -> DataFrame:
    """dir, name, line: a heading for each directory (the name empty) and a line for each of its files with its state, to be written in the order of (dir, name).
    No directory is gathered in one row."""
    heads = registry.select("dir").distinct().select("dir", F.lit("").alias("name"), F.concat(F.lit("files of "), "dir", F.lit(":")).alias("line"))
    return heads.unionByName(registry.select("dir", F.col("filename").alias("name"), F.concat_ws(" ", "filename", "status").alias("line")))


# reports as lines: (section, place, line), to be written in that order; no report is gathered in one task


def block_lines(df: DataFrame, section: Column, *parts: Column) -> DataFrame:
    """section, place, line: the lines that each row gives, in turn; null parts give none."""
    return df.select(section.alias("section"), F.posexplode(F.array_compact(F.array(*parts))).alias("place", "line"))


def write_lines(lines: DataFrame, folder: str) -> None:
    """The lines of a report, in order, as text files that follow each other by name."""
    lines.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(folder)


def toml_value(c: Column) -> Column:
    return F.concat(F.lit('"'), scalars.escape_toml(c), F.lit('"'))


def plan_lines(meta: DataFrame, steps: DataFrame, conflicts: DataFrame) -> DataFrame:
    """A migration plan as TOML: [metadata], a [[steps]] block each, a [[conflicts]] block each; null fields are left out.

    meta: one row of any columns; steps: step and any columns; conflicts: id and any columns.
    """

    def field(df: DataFrame, c: str) -> Column:
        text = toml_value(F.col(c)) if df.schema[c].dataType.simpleString() == "string" else F.col(c).cast("string")
        return F.concat(F.lit(f"{c} = "), text)

    def blocks(df: DataFrame, head: str, section: Column) -> DataFrame:
        return block_lines(df, section, F.lit(head), *(field(df, c) for c in df.columns), F.lit(""))

    place = lambda k, c: F.concat(F.lit(f"{k}:"), c)
    return blocks(meta, "[metadata]", F.lit("0:")).unionByName(blocks(steps, "[[steps]]", place(1, F.lpad(F.col("step").cast("string"), 12, "0")))).unionByName(blocks(conflicts, "[[conflicts]]", place(2, F.col("id").cast("string"))))


#: Files that get no printed card.
NO_CARD, NO_CARD_UNDER = (".txt", ".json", ".sqlite-wal", ".sqlite-shm"), (".archive/", ".planning/", "vendor/", "snapshots/")


def card_lines(registry: DataFrame) -> DataFrame:
    """section (the card's file name), place, line of a printed card of every file that gets one."""
    path = F.col("filepath")
    skip = F.lit(False)
    for end in NO_CARD:
        skip = skip | F.lower(path).endswith(end)
    for under in NO_CARD_UNDER:
        skip = skip | path.startswith(under) | path.contains("/" + under)
    fields = (F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in registry.columns)
    return block_lines(registry.where(~skip), F.concat(F.regexp_replace(path, r"[/\\]", "_"), F.lit(".txt")), F.concat(F.lit("IDENTITY CARD "), path), *fields)


def phase_lines(files: DataFrame) -> DataFrame:
    """Markdown of files by phase: a heading with the count, then a line a file."""
    heads = files.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "GREEN").alias("green"))
    top = block_lines(heads, F.col("phase"), F.concat(F.lit("## "), "phase"), F.concat(F.col("n").cast("string"), F.lit(" files, "), F.col("green").cast("string"), F.lit(" green")))
    rows = files.select(F.concat("phase", F.lit("/"), "filepath").alias("section"), F.lit(0).alias("place"), F.concat(F.lit("- "), "filepath", F.lit(" "), "status").alias("line"))
    return top.unionByName(rows)


def check_lines(checks: DataFrame, issues: DataFrame, most: int = 20) -> DataFrame:
    """Markdown of checks (id, title, message) and their issues (id, issue): the result, a table row a check, and the issues of those that have any,
    the first most of each by text."""
    count = issues.groupBy("id").agg(F.count("*").alias("n"))
    results = checks.join(count, "id", "left").na.fill(0, ["n"])
    ok = F.col("n") == 0
    total = results.agg(F.count_if(ok).alias("ok"), F.count("*").alias("all"))
    head = block_lines(total, F.lit("0"), F.lit("# Checks"), F.concat(F.col("ok").cast("string"), F.lit("/"), F.col("all").cast("string"), F.lit(" checks pass")))
    table = results.select(F.concat(F.lit("1:"), "id").alias("section"), F.lit(0).alias("place"), F.concat(F.lit("| "), "id", F.lit(" "), "title", F.lit(" | "), F.when(ok, "ok").otherwise("fail"), F.lit(" | "), "message", F.lit(" |")).alias("line"))
    section = F.concat(F.lit("2:"), "id").alias("section")
    ranked = issues.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("issue"))).where(F.col("place") <= most)  # limited before the shuffle
    shown = ranked.join(checks.select("id"), "id", "left_semi").select(section, "place", F.concat(F.lit("- "), "issue").alias("line"))
    titles = results.where(~ok).select(section, F.lit(0).alias("place"), F.concat(F.lit("## "), "id").alias("line"))
    more = results.where(F.col("n") > most).select(section, F.lit(most + 1).alias("place"), F.concat(F.lit("- ... and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line"))
    return head.unionByName(table).unionByName(shown).unionByName(titles).unionByName(more)


def top_lines(df: DataFrame, section: str, title: str, line: Column, order: list[Column], most: int) -> DataFrame:
    """A report's list: its title, the first most lines in an order, and how many more there are."""
    head = df.agg(F.count("*").alias("n"))
    first = df.select(line.alias("line"), *(c.alias(f"_{i}") for i, c in enumerate(order)))
    keys = [F.col(f"_{i}") for i in range(len(order))]
    kept = first.orderBy(*keys).limit(most).select(F.row_number().over(Window.orderBy(*keys)).alias("place"), F.concat(F.lit("- "), "line").alias("line"))  # most rows
    said = head.select(F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(f"## {title}").alias("line")), F.struct(F.lit(most + 1).alias("place"), F.when(F.col("n") > most, F.concat(F.lit("... and "), (F.col("n") - most).cast("string"), F.lit(" more"))).alias("line")))).alias("x")).select("x.*").where("line IS NOT NULL")
    return kept.unionByName(said).select(F.lit(section).alias("section"), "place", "line")


def migration_lines(summary: DataFrame, steps: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Markdown of a migration: outcome and measures (one row of summary), conflicts by kind, and a line a step.

    summary: any columns; steps: step, action, description; conflicts: id, conflict.
    """
    head = block_lines(summary, F.lit("0"), F.lit("# Migration report"), *(F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in summary.columns))
    kinds = block_lines(conflicts.groupBy("conflict").agg(F.count("*").alias("n")), F.concat(F.lit("1:"), "conflict"), F.concat(F.lit("- "), "conflict", F.lit(": "), F.col("n").cast("string")))
    plan = block_lines(steps, F.concat(F.lit("2:"), F.lpad(F.col("step").cast("string"), 12, "0")), F.concat(F.col("step").cast("string"), F.lit(". "), "action", F.lit(": "), "description"))
    return head.unionByName(kinds).unionByName(plan)


def dump_lines(df: DataFrame, table: str, key: str, form: str) -> DataFrame:
    """section (the key), place, line: a table's rows as csv, json, or sql inserts."""
    text = lambda c: F.col(c).cast("string")
    if form == "json":
        line = F.to_json(F.struct(*sorted(df.columns)))
    elif form == "sql":
        one = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(text(c), F.lit("'"), F.lit("''")), F.lit("'")) if df.schema[c].dataType.simpleString() == "string" else text(c), F.lit("NULL"))
        line = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), F.concat_ws(", ", *(one(c) for c in df.columns)), F.lit(");"))
    else:
        one = lambda c: F.when(text(c).rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text(c), F.lit("")))
        line = F.concat_ws(",", *(one(c) for c in df.columns))
    return df.select(text(key).alias("section"), F.lit(0).alias("place"), line.alias("line"))


def risk_records(identities: DataFrame) -> DataFrame:
    """json of each file (path, origin) whose birth time is only that of its last change; none on a clean run, which empties the report."""
    return identities.where(F.col("origin") == "mtime-fallback").select(F.to_json(F.struct("path", "origin")).alias("json"))


def error_summary(runs: DataFrame) -> DataFrame:
    """One row: runs (hook, error) that went well and that failed, and the errors by how often each came up, as JSON."""
    by = runs.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
    listed = by.agg(F.to_json(F.array_sort(F.collect_list(F.struct("error", "n")))).alias("errors"))  # a row a kind of error
    return runs.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("fail")).join(listed)


def with_keys(rows: DataFrame, owners: DataFrame, name: str, keep: bool) -> DataFrame:
    """rows with owner_id, the id of the owner (id, name) that a column names; rows without one go or, keep, have none."""
    return rows.join(owners.select(F.col("id").alias("owner_id"), F.col("name").alias(name)), name, "left" if keep else "inner")


def export(df: DataFrame, folder: str, form: str) -> None:
    """A table as json, csv or parquet."""
    df.write.mode("overwrite").format(form).option("header", True).save(folder)
