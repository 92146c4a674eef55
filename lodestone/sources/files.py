"""Source trees, schema cards and plans as DataFrames."""

from __future__ import annotations

import tomllib
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars

#: What a scan takes and what it passes by; a caller adds the folder it writes itself.
CODE = (".js", ".ts", ".jsx", ".tsx", ".vue", ".py", ".rs", ".go", ".md", ".txt", ".json")
IGNORED = ("node_modules", ".git", "dist", "build", ".venv", "venv", "__pycache__", ".archive", ".planning", "vendor", "snapshots")

CARD = """fingerprint STRING, filepath STRING, filename STRING, sha256Hash STRING, fileSizeBytes LONG, status STRING,
reachabilityScore DOUBLE, impactRadius LONG, lifecyclePhase STRING, birthTimestamp STRING, lastModified STRING, lastIndexed STRING, isEntryPoint BOOLEAN,
exports ARRAY<STRUCT<name: STRING, kind: STRING, signature: STRING, returnType: STRING, paramCount: INT, sourceFile: STRING, line: INT, exportVisibility: STRING>>,
imports ARRAY<STRUCT<source: STRING, specifiers: ARRAY<STRUCT<name: STRING, alias: STRING, isType: BOOLEAN>>, importType: STRING, line: INT>>,
connections STRUCT<importedBy: ARRAY<STRING>, imports: ARRAY<STRING>>,
intent STRUCT<purpose: STRING, dependsOnBehavior: STRING, valueStatement: STRING>,
mutationCount LONG, lastMutation STRUCT<type: STRING, actor: STRING, timestamp: STRING>"""


def _below(root: str) -> Column:
    """A file's path below root, of whatever store root names."""
    return F.substring_index("path", urlsplit(root).path.rstrip("/") + "/", -1)


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = CODE, ignored: tuple[str, ...] = IGNORED, own: tuple[str, ...] = ("connection-state.json",)) -> DataFrame:
    """path (relative), bytes, modified, sha256, content of the source files below root. own: names of files, or of folders of parts as Spark writes them."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = df.withColumn("path", _below(root))
    parts = F.split("path", "/")
    skip = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(*ignored))
    df = df.where(scalars.extname(F.col("path")).isin(*extensions) & ~skip & ~F.exists(parts, lambda x: x.isin(*own)))
    return df.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def whole(files: DataFrame) -> DataFrame:
    """path, bytes of scanned files, where a folder of parts, named with the extension of the files in it as Spark writes a table, counts as one file."""
    extension = scalars.extname(F.col("path"))
    parts = F.split("path", "/")
    place = F.array_position(F.transform(parts, scalars.extname), extension)
    table = F.array_join(F.slice(parts, 1, place.cast("int")), "/")
    return files.select(F.when(extension == "", F.col("path")).otherwise(table).alias("path"), "bytes").groupBy("path").agg(F.sum("bytes").alias("bytes"))


def texts(files: DataFrame, *under: str) -> DataFrame:
    """path, text of scanned files, optionally below some directories, by path."""
    if under:
        cond = F.lit(False)
        for d in under:
            cond = cond | F.col("path").startswith(d.rstrip("/") + "/")
        files = files.where(cond)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def cards(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Schema cards of a folder, a file each or (lines) a line each; what is no JSON, or has no fingerprint, is left out."""
    df = spark.read.schema(CARD + ", _corrupt_record STRING").option("multiLine", not lines).option("mode", "PERMISSIVE").json(folder)
    return df.where(F.col("_corrupt_record").isNull() & F.col("fingerprint").isNotNull()).drop("_corrupt_record")


def plan(spark: SparkSession, text: str, table: str) -> DataFrame:
    """An array of tables of a TOML plan; a plan is a small document, read by the driver."""
    rows = tomllib.loads(text).get(table, [])
    return spark.createDataFrame([{k: v if isinstance(v, (int, float, str, bool)) else str(v) for k, v in r.items()} for r in rows]) if rows else spark.createDataFrame([], "id string")


def identity(files: DataFrame, persisted: DataFrame) -> DataFrame:
    """birth and origin of files (path, birthtime, mtime): the persisted one, a reliable birth time, else the modification time."""
    both = files.join(persisted.select("path", F.col("birth").alias("_had")), "path", "left")
    reliable = F.col("birthtime") >= F.lit("1980-01-01").cast("timestamp")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    birth = F.coalesce("_had", F.when(reliable, iso(F.col("birthtime"))), iso(F.col("mtime")))
    origin = F.when(F.col("_had").isNotNull(), "reused-persisted").when(reliable, "stat-birthtime").otherwise("mtime-fallback")
    return both.select(*files.columns, birth.alias("birth"), origin.alias("origin"))


def wrong_shape(df: DataFrame, wanted: dict[str, str]) -> tuple[list[str], list[str], list[str]]:
    """Missing, additional and wrongly typed columns against wanted (name -> type)."""
    have = dict(df.dtypes)
    return sorted(set(wanted) - set(have)), sorted(set(have) - set(wanted)), sorted(k for k in wanted if k in have and have[k] != wanted[k])


def in_enum(column: Column, values: tuple[str, ...]) -> Column:
    """Whether a value is allowed; null is."""
    return column.isNull() | column.isin(*values)


def listing(spark: SparkSession, root: str, below: str = "") -> DataFrame:
    """path (below root), bytes, folder (whether it is one) of the entries of one directory below root; a folder that holds files, at any depth, has
    the bytes of all of them. Refuses to leave root.
    """
    parts = [p for p in below.split("/") if p not in ("", ".")]
    if ".." in parts or below.startswith("/") or "\\" in below:
        raise ValueError(f"not below the root: {below}")
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load("/".join([base, *parts]))
    steps = F.split(_below(base), "/")
    entry = F.array_join(F.slice(steps, 1, len(parts) + 1), "/")
    return df.select(entry.alias("path"), "length", (F.size(steps) > len(parts) + 1).alias("folder")).groupBy("path", "folder").agg(F.sum("length").alias("bytes")).select("path", "bytes", "folder")


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """name, position, column, type of the columns of tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, i, f.name, f.dataType.simpleString()) for n, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "name string, position long, column string, type string")


def dependencies(packages: DataFrame) -> DataFrame:
    """path, kind, package, version of package files (path, text as JSON): both kinds of dependencies."""
    kinds = ("dependencies", "devDependencies")
    rows = [packages.select("path", F.lit(k).alias("kind"), F.explode(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>")).alias("package", "version")) for k in kinds]
    return rows[0].unionByName(rows[1])


def summary(files: DataFrame, configs: tuple[str, ...] = ("package.json", "tsconfig.json")) -> DataFrame:
    """dir, files, bytes, largest, extensions (distinct), configs (files of those names) of files (path, bytes), by directory."""
    name = scalars.basename(F.col("path"))
    rows = files.withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.count_distinct(scalars.extname(F.col("path"))).alias("extensions"), F.count_if(name.isin(*configs)).alias("configs"))
