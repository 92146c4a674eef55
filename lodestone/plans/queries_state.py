"""Queries of keyed streaming state (T) and of bucketed snapshots (M): mutations are written as a feed of files, and streamed."""

from pyspark.sql import functions as F

from lodestone.operators import snapshots as M
from lodestone.plans.queries_sources import _folder
from lodestone.registry import query
from lodestone.streaming import state as S


def _feed(t, df):
    """df as a stream, from JSON files that were written to a folder."""
    source = _folder(t)
    df.write.json(source)
    S.with_store(t.spark)
    return t.spark.readStream.schema(df.schema).json(source)


def _out(t, df):
    out = _folder(t)
    S.run_all(df, out, out + "-state")
    return t.spark.read.parquet(out)


FEED = """SELECT fingerprint AS path, CASE kind WHEN 'ERROR' THEN 'unlink' WHEN 'PURCHASE' THEN 'add' ELSE 'change' END AS type, CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING) AS sha, ts, id AS seq FROM {mutations}"""


@query(f"""WITH e AS ({FEED}), s AS (SELECT *, last_value(CASE WHEN type <> 'change' THEN type END IGNORE NULLS) OVER w AS was, last_value(CASE WHEN type <> 'unlink' THEN sha END IGNORE NULLS) OVER w AS had FROM e
 WINDOW w AS (PARTITION BY path ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT path, type, sha, coalesce(had, '0') AS had, coalesce(was = 'add', CAST(substr(path, 2) AS BIGINT) % 2 = 0) AS there FROM s),
m AS (SELECT path, 'CREATE' AS kind, NULL AS old, sha AS new FROM k WHERE type = 'add' UNION ALL SELECT path, 'DELETE', had, NULL FROM k WHERE type = 'unlink' AND there UNION ALL SELECT path, 'EDIT', had, sha FROM k WHERE type = 'change' AND there AND sha <> had)
SELECT path, kind, old, new, count(*) AS n FROM m GROUP BY ALL""")
def t03_keyed_state(t):
    changes = t.sql(FEED).withColumn("ts", F.col("ts").cast("timestamp"))
    registry = t.mutations.select(F.col("fingerprint").alias("path"), F.lit("0").alias("sha")).where(F.substring("path", 2, 20).cast("long") % 2 == 0).distinct()
    return _out(t, S.mutations(_feed(t, changes), registry)).groupBy("path", "kind", "old", "new").agg(F.count("*").alias("n"))


@query("SELECT fingerprint AS path, count(CASE WHEN last IS NULL OR ts > last THEN 1 END) AS since FROM (SELECT fingerprint, ts, max(CASE WHEN kind = 'PURCHASE' THEN ts END) OVER (PARTITION BY fingerprint) AS last FROM {mutations}) GROUP BY fingerprint")
def t12_session_state(t):
    sessions = t.mutations.select(F.col("fingerprint").alias("path"), F.col("ts").cast("timestamp").alias("at"), (F.col("kind") == "PURCHASE").alias("touched"))
    return _out(t, S.sessions_since(_feed(t, sessions))).groupBy("path").agg(F.max_by("since", "at").alias("since"))


def _bursts(gap):
    return f"""WITH g AS (SELECT fingerprint, kind, ts, id, max(ts) OVER (ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {{mutations}}),
 b AS (SELECT fingerprint, kind, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL {gap} SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS burst FROM g),
 s AS (SELECT burst, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM b GROUP BY burst)
SELECT DISTINCT started, ended, fingerprint AS path, lower(kind) AS type FROM b JOIN s USING (burst)"""


def _streamed_bursts(t, gap):
    changes = t.mutations.select(F.col("fingerprint").alias("path"), F.lower("kind").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    last = changes.agg(F.max("ts").alias("ts"))
    beats = last.select(F.lit("").alias("path"), F.lit(S.HEARTBEAT).alias("type"), F.explode(F.array(*(F.col("ts") + F.expr(f"INTERVAL {d} DAYS") for d in (1, 2)))).alias("ts"))
    found = _out(t, S.bursts(_feed(t, changes.unionByName(beats)), gap * 1000, buckets=4))
    return found.select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "path", "type")


@query(_bursts(600))
def t02_burst_stream(t):
    return _streamed_bursts(t, 600)


@query(_bursts(2000))
def t08_background_bursts(t):
    return _streamed_bursts(t, 2000)


@query("SELECT doc_id, CASE WHEN doc_id < 10 THEN 'moved' ELSE phase END AS phase FROM {registry} UNION ALL SELECT -1, 'new'")
def m01_bucketed_upsert(t):
    root = _folder(t)
    M.publish_bucketed(t.spark, root, "files", t.registry.select("doc_id", "phase"), ["doc_id"], 1)
    rows = t.registry.where("doc_id < 10").select("doc_id", F.lit("moved").alias("phase")).unionByName(t.registry.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("new").alias("phase")))
    M.change(t.spark, root, "files", rows, 2)
    return M.current(t.spark, root, "files")
