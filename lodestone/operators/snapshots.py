"""Upserts, deletes and state changes as snapshot rewrites.

A table is a DataFrame; a change returns the new snapshot. publish() writes snapshots of several tables to fresh folders and then a
pointer file that names them, so that a cascade over tables becomes visible at once. A table in buckets is changed by change(), which writes only the buckets
that the change touches; the pointer names a folder for each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.functions import scalars

KEEP_FOREVER = ("CREATE", "DELETE", "LOCK", "PURGE", "CONCEPT")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], preserve: Sequence[str] = ()) -> DataFrame:
    """Rows of new replace those of old with the same key; columns in preserve keep their old value where there is one."""
    if preserve:
        had = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in preserve))
        new = new.join(had, list(keys), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in preserve}).drop(*(f"_{c}" for c in preserve))
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ON CONFLICT DO UPDATE: values of new where not null, else those of old."""
    a = old.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in old.columns if c != key))
    both = a.join(new, key, "full_outer")
    return both.select(key, *(F.coalesce(c, f"_{c}").alias(c) if c in new.columns else F.col(f"_{c}").alias(c) for c in old.columns if c != key))


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT OR IGNORE."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def delete(old: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """old without rows that name a key of gone (its first column) in any of columns."""
    key = gone.columns[0]
    keys = gone.select(key).distinct()
    for c in columns:
        old = old.join(keys.withColumnRenamed(key, c), c, "left_anti").select(*old.columns)
    return old


def cascade(tables: Mapping[str, DataFrame], gone: DataFrame, columns: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """All tables without the rows that name a key of gone; columns: of each table that hold a key."""
    return {name: delete(df, gone, *columns[name]) if name in columns else df for name, df in tables.items()}


def update(df: DataFrame, where: Column, **values: object) -> DataFrame:
    """UPDATE ... WHERE; values are columns or literals."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def retention(log: DataFrame, cutoff: Column, kinds: Sequence[str] = KEEP_FOREVER) -> DataFrame:
    """Log rows that are kept for ever or not older than the cutoff."""
    return log.where(F.col("kind").isin(*kinds) | (F.col("ts") >= cutoff))


def purge_development(files: DataFrame, log: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files with those of wanted (fingerprint) in PRODUCTION, and log (fingerprint, kind, changed, actor) without their mutations other than PRODUCTION and
    PURGE, but with a PURGE mutation of each, that says how many went."""
    keys = wanted.select("fingerprint").distinct().withColumn("_wanted", F.lit(True))
    marked = log.join(keys, "fingerprint", "left").withColumn("_gone", F.coalesce(F.col("_wanted") & ~F.col("kind").isin("PRODUCTION", "PURGE"), F.lit(False)))
    counts = keys.join(marked.where("_gone").groupBy("fingerprint").agg(F.count("*").alias("n")), "fingerprint", "left")
    values = {"fingerprint": F.col("fingerprint"), "kind": F.lit("PURGE"), "changed": F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("purgedMutations"))), "actor": F.lit("INDEXER")}
    types = {f.name: f.dataType for f in log.schema}
    new = counts.select(*(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in log.columns))
    hit = files.join(keys, "fingerprint", "left")
    return hit.withColumn("phase", F.when(F.col("_wanted"), "PRODUCTION").otherwise(F.col("phase"))).select(*files.columns), marked.where("not _gone").select(*log.columns).unionByName(new)


def claim(tickets: DataFrame, providers: DataFrame, claims: DataFrame) -> DataFrame:
    """Tickets with claims (id, claimant) applied: only open, unclaimed ones, by an active provider."""
    active = providers.where("active").select(F.col("name").alias("claimant"))
    valid = claims.join(active, "claimant", "left_semi").groupBy("id").agg(F.min("claimant").alias("claimant"))
    both = tickets.join(valid, "id", "left")
    free = F.col("claimed_by").isNull() & F.col("resolved").isNull()
    return both.withColumn("claimed_by", F.when(free, F.col("claimant")).otherwise(F.col("claimed_by"))).select(*tickets.columns)


def lock(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files with CONCEPT and DEVELOPMENT phases locked, and a LOCK mutation for each."""
    hit = F.col("phase").isin("CONCEPT", "DEVELOPMENT")
    log = files.where(hit).select("fingerprint", F.lit("LOCK").alias("kind"))
    return update(files, hit, phase="LOCKED"), log


def flag_stale(files: DataFrame, threshold: int = 5) -> DataFrame:
    """Active files not touched for threshold sessions become flagged."""
    return update(files, (F.col("sessions") >= threshold) & (F.col("lifecycle") == "active"), lifecycle="flagged")


def archive_flagged(files: DataFrame, today: Column, grace_days: int = 7) -> DataFrame:
    """Flagged files become archived, with the day their grace ends."""
    return files.withColumn("expires", F.when(F.col("lifecycle") == "flagged", F.date_add(today, grace_days))).transform(lambda d: update(d, F.col("lifecycle") == "flagged", lifecycle="archived"))


def _pointers(spark: SparkSession, root: str) -> list[dict]:
    """Pointers of all published versions, a row a version, oldest first; none where nothing is published."""
    try:
        rows = spark.read.text(f"{root}/_pointer_*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((json.loads(r["value"]) for r in rows), key=lambda p: p["version"])


def _point(spark: SparkSession, root: str, version: int, tables: Mapping[str, object]) -> None:
    spark.createDataFrame([(json.dumps({"version": version, "tables": dict(tables)}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/_pointer_{version:08d}")


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], version: int) -> bool:
    """Writes all tables to fresh folders and then points at them: readers see all of the change or none, and what they read is never written again.

    A version that is published already is left as it is, so a batch that runs again after a stop does no harm. Returns whether it was written.
    Tables of the version before that are not named stay.
    """
    old = _pointers(spark, root)
    if any(p["version"] == version for p in old):
        return False
    folder = f"v{version}-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folder}/{name}")
    _point(spark, root, version, {**(old[-1]["tables"] if old else {}), **{n: f"{folder}/{n}" for n in tables}})
    return True


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of the newest published version."""
    where = _pointers(spark, root)[-1]["tables"][name]
    if isinstance(where, str):
        return spark.read.parquet(f"{root}/{where}")
    return _buckets(spark, root, where, range(where["n"]))


def _bucket_of(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _buckets(spark: SparkSession, root: str, where: Mapping, which) -> DataFrame:
    """The rows of some buckets of a table."""
    kind = StructType.fromJson(where["schema"])
    folders = [f"{root}/{where['at'][str(b)]}" for b in which if str(b) in where["at"]]
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def publish_bucketed(spark: SparkSession, root: str, name: str, df: DataFrame, keys: Sequence[str], version: int, n: int = 64) -> bool:
    """publish() of one table in n buckets by the hash of its keys, each a folder of its own, so that change() can rewrite some of them."""
    old = _pointers(spark, root)
    if any(p["version"] == version for p in old):
        return False
    where = {"n": n, "keys": list(keys), "schema": json.loads(df.schema.json()), "at": _write_buckets(root, df, keys, n, version, name)}
    _point(spark, root, version, {**(old[-1]["tables"] if old else {}), name: where})
    return True


def _write_buckets(root: str, df: DataFrame, keys: Sequence[str], n: int, version: int, name: str) -> dict[str, str]:
    """bucket -> folder of the buckets that df has rows in."""
    folder = f"v{version}-{uuid.uuid4().hex[:12]}/{name}"
    df.withColumn("_bucket", _bucket_of(keys, n)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    kind = StructType([*df.schema.fields, StructField("_bucket", IntegerType())])
    had = df.sparkSession.read.schema(kind).parquet(f"{root}/{folder}").select("_bucket").distinct().collect()  # n rows at most
    return {str(r[0]): f"{folder}/_bucket={r[0]}" for r in had}


def change(spark: SparkSession, root: str, name: str, rows: DataFrame, version: int, apply: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> bool:
    """Applies rows to a bucketed table and publishes it: only the buckets of their keys are read and written, all others stay where they are.

    apply: what to make of the old rows of those buckets and the new ones, whose keys are the table's; an upsert if not given.
    """
    old = _pointers(spark, root)
    if any(p["version"] == version for p in old):
        return False
    where = old[-1]["tables"][name]
    keys, n = where["keys"], where["n"]
    touched = [r[0] for r in rows.select(_bucket_of(keys, n)).distinct().collect()]  # n rows at most
    before = _buckets(spark, root, where, touched)
    after = upsert(before, rows, keys) if apply is None else apply(before, rows)
    at = {b: f for b, f in where["at"].items() if int(b) not in touched}
    _point(spark, root, version, {**old[-1]["tables"], name: {**where, "at": {**at, **_write_buckets(root, after, keys, n, version, name)}}})
    return True


def clear(df: DataFrame) -> DataFrame:
    """The snapshot of a table that lost all its rows: its columns stay."""
    return df.where(F.lit(False))


def register_concepts(files: DataFrame, entries: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """files with the planned files (filepath, actor) added, which are not on disk yet, and a CONCEPT mutation (fingerprint, kind, actor) for each."""
    print_ = scalars.fingerprint(F.col("filepath"), F.lit(now))
    values = {"fingerprint": print_, "filepath": F.col("filepath"), "filename": scalars.basename(F.col("filepath")), "birth": F.lit(now), "bytes": F.lit(0), "status": F.lit("CONCEPT"), "reach": F.lit(0.0), "impact": F.lit(0), "phase": F.lit("CONCEPT")}
    kinds = {f.name: f.dataType for f in files.schema}
    rows = entries.select(*(values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in files.columns))
    return upsert(files, rows, ["fingerprint"]), entries.select(print_.alias("fingerprint"), F.lit("CONCEPT").alias("kind"), F.coalesce("actor", F.lit("DEVELOPER")).alias("actor"))


def slots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters of files (file_id, total, last_pass, last_ts) after new insights (file_id, pass_number, ts): sums and maxima, slots made as needed."""
    added = new.groupBy("file_id").agg(F.count("*").alias("_n"), F.max("pass_number").alias("_pass"), F.max("ts").alias("_ts"))
    both = old.join(added, "file_id", "full_outer")
    return both.select("file_id", (F.coalesce("total", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("total"), F.greatest("last_pass", "_pass").alias("last_pass"), F.coalesce("_ts", "last_ts").alias("last_ts"))


def atomically(spark: SparkSession, root: str, names: Sequence[str], change: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], version: int) -> str | None:
    """Applies a change to the published tables and publishes the result; if it fails, also while it is written, the tables stay as they were.

    Returns the error, or None. Nothing has to be undone: a version counts only once its pointer is written, after all its tables.
    """
    try:
        publish(spark, root, change({n: current(spark, root, n) for n in names}), version)
    except Exception as e:  # whatever a caller's change raises
        return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return None
