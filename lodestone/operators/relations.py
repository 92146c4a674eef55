"""Join operators over files, connections, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions probed for an import, in order.
EXTENSIONS = ("", ".js", ".ts", ".jsx", ".tsx", ".vue", ".mjs")
#: Modules of the runtime itself.
BUILTINS = ("assert", "buffer", "child_process", "crypto", "events", "fs", "http", "https", "net", "os", "path", "process", "stream", "url", "util", "worker_threads", "zlib")


def neighbours(edges: DataFrame, nodes: DataFrame, at: str, keep: list[str]) -> DataFrame:
    """Edges with the columns of the node at one end (at: src or dst) beside them."""
    side = nodes.select(F.col("node_id").alias(at), *(F.col(c).alias(f"{at}_{c}") for c in keep))
    return edges.join(side, at)


def consumers(edges: DataFrame, nodes: DataFrame, suffix: str) -> DataFrame:
    """Nodes with an edge to a node whose path ends in suffix, without those nodes themselves."""
    targets = nodes.where(F.col("path").endswith(suffix)).select(F.col("node_id").alias("dst"))
    sources = edges.join(targets, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
    return nodes.join(sources, "node_id", "left_semi").join(targets.withColumnRenamed("dst", "node_id"), "node_id", "left_anti")


def related(edges: DataFrame, nodes: DataFrame, node_id: int) -> DataFrame:
    """path, direction, edge_type of a node's neighbours; a path met both ways counts as outbound."""
    out = edges.where(F.col("src") == node_id).select(F.col("dst").alias("node_id"), F.lit("outbound").alias("direction"), F.lit(0).alias("_rank"), "edge_type", "edge_id")
    into = edges.where(F.col("dst") == node_id).select(F.col("src").alias("node_id"), F.lit("inbound").alias("direction"), F.lit(1).alias("_rank"), "edge_type", "edge_id")
    both = out.unionByName(into).where(F.col("node_id") != node_id).join(nodes.select("node_id", "path"), "node_id")
    return both.groupBy("path").agg(F.min_by(F.struct("direction", "edge_type"), F.struct("_rank", "edge_id")).alias("_x")).select("path", "_x.direction", "_x.edge_type")


def induced(edges: DataFrame, ids: DataFrame, both: bool = True) -> DataFrame:
    """Edges with both ends (or, not both, either end) in ids (node_id)."""
    a, b = ids.select(F.col("node_id").alias("src")), ids.select(F.col("node_id").alias("dst"))
    if both:
        return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
    return edges.join(a, "src", "left_semi").unionByName(edges.join(a, "src", "left_anti").join(b, "dst", "left_semi"))


def boundary(edges: DataFrame, nodes: DataFrame, inside: Column) -> DataFrame:
    """Edges that touch a set of nodes (inside: a condition on path), as IN, OUT or INTERNAL, with both paths."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("path").alias("src_path"), inside.alias("_a"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("path").alias("dst_path"), inside.alias("_b"))
    found = edges.join(a, "src", "left").join(b, "dst", "left")
    flow = F.when(F.col("_a") & F.col("_b"), "INTERNAL").when(F.col("_a"), "OUT").when(F.col("_b"), "IN")
    return found.withColumn("flow", flow).where("flow is not null").drop("_a", "_b")


def file_flows(edges: DataFrame, nodes: DataFrame, node_id: int) -> DataFrame:
    """direction, other_path, status (SAFE if unknown) and confidence (1 if unknown) of a node's edges."""
    path = nodes.select("node_id", F.col("path").alias("other_path"))
    out = edges.where(F.col("src") == node_id).withColumn("node_id", F.col("dst")).withColumn("direction", F.lit("out"))
    into = edges.where(F.col("dst") == node_id).withColumn("node_id", F.col("src")).withColumn("direction", F.lit("in"))
    both = out.unionByName(into).join(path, "node_id", "left")
    return both.select("edge_id", "direction", "other_path", F.coalesce("status", F.lit("SAFE")).alias("status"), F.coalesce("confidence", F.lit(1.0)).cast("double").alias("confidence"))


def normalised(path: Column) -> Column:
    """A path with / for \\, and . and .. folded; .. above the start is kept."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")

    def fold(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when((part == "") | (part == "."), done).when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_relative(specifier: Column) -> Column:
    """Whether a specifier names a file and not a builtin, a package or an absolute path."""
    return F.coalesce(specifier.startswith("./") | specifier.startswith("../") | specifier.isin(".", ".."), F.lit(False))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer, specifier) with target: the first of its candidates that is a file, or null.

    Candidates, in order: the path itself, with each extension, then index files below it. They are exploded with
    their rank and meet the files in one equi-join; the lowest rank of an import wins in a partial aggregate.
    """
    base = normalised(F.concat_ws("/", dirname(F.replace("importer", F.lit("\\"), F.lit("/"))), F.col("specifier")))
    tails = [*EXTENSIONS, *("/index" + e for e in EXTENSIONS[1:])]
    asked = imports.select("importer", "specifier").distinct()
    candidates = asked.where(is_relative(F.col("specifier"))).select("importer", "specifier", F.posexplode(F.array(*(F.concat(base, F.lit(e)) for e in tails))).alias("_rank", "_path"))
    known = files.select("filepath", F.replace("filepath", F.lit("\\"), F.lit("/")).alias("_path")).groupBy("_path").agg(F.min("filepath").alias("filepath"))
    best = candidates.join(known, "_path").groupBy("importer", "specifier").agg(F.min_by("filepath", "_rank").alias("target"))
    return imports.join(best, ["importer", "specifier"], "left")


def imported_by(connections: DataFrame, registry: DataFrame) -> DataFrame:
    """target, importers: sorted file paths that import it; an unknown importer stands as its fingerprint."""
    names = registry.select(F.col("fingerprint").alias("source"), "filepath")
    found = connections.join(names, "source", "left")
    return found.groupBy("target").agg(F.array_sort(F.collect_set(F.coalesce("filepath", "source"))).alias("importers"))


def best_export(wanted: DataFrame, exports: DataFrame) -> DataFrame:
    """wanted (name, path) with the export of that name: the one at the same path, else the first by ordinal."""
    x = exports.select("name", F.col("path").alias("export_path"), "ordinal")
    both = wanted.join(x, "name", "left").withColumn("_other", (F.col("export_path") != F.col("path")).cast("int"))
    w = Window.partitionBy("name", "path").orderBy(F.asc_nulls_last("_other"), "ordinal")
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_other")


def breaking_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change (removed, new, changed) between two tables of exports (name, signature)."""
    both = old.withColumnRenamed("signature", "_a").join(new.withColumnRenamed("signature", "_b"), "name", "full_outer")
    change = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")
