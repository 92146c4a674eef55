"""File-change streams: debounce, stateful apply, fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestone.operators import snapshots
from lodestone.operators.lineage import settled

EVENT = "path STRING, type STRING, ts TIMESTAMP, sha STRING"


def events(spark, folder: str) -> DataFrame:
    """A stream of change events from JSON files."""
    return spark.readStream.schema(EVENT).json(folder)


def debounce(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """window, path, type, n: one row for each (path, type) of a burst, a burst ending when nothing happens for gap.

    A burst is a session of its path, which keeps state small and spread; flushes() joins bursts of all paths as one timer
    would. Works on streams (append mode, with the watermark) and on tables.
    """
    marked = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return marked.groupBy(F.session_window("ts", gap).alias("window"), "path", "type").agg(F.count("*").alias("n"))


def flushes(changes: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """start, end, path, type: what one timer over all paths, reset by each event, would flush, a row for each (path, type) of a burst. For tables;
    state.bursts() does the same for streams.

    Events are reduced to sessions of a path before. Sessions are dealt out by ranges of their start; the latest end of all ranges
    before, a row a range, tells whether a range's first session goes on with a burst. So no task holds all sessions.
    """
    per_path = debounce(changes, gap).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "path", "type")
    spans = settled(per_path.repartitionByRange("start").withColumn("_range", F.spark_partition_id()))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.groupBy("_range").agg(F.max("end").alias("_end")).select("_range", F.max("_end").over(upto).alias("_before"))  # a row a range
    earlier = Window.partitionBy("_range").orderBy("start", "path", "type").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.greatest(F.max("end").over(earlier), "_before") < F.col("start"), F.lit(True))
    marked = spans.join(F.broadcast(ends), "_range").withColumn("_fresh", fresh.cast("long"))
    marked = settled(marked.withColumn("_nth", F.sum("_fresh").over(earlier.rowsBetween(Window.unboundedPreceding, 0))))
    bursts = marked.groupBy("_range").agg(F.sum("_fresh").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    named = marked.join(F.broadcast(bursts), "_range").withColumn("_burst", F.col("_first") + F.col("_nth"))
    spans = named.groupBy("_burst").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return named.select("_burst", "path", "type").distinct().join(spans, "_burst").select("start", "end", "path", "type")


def session_counts(sessions: DataFrame) -> DataFrame:
    """path, since: sessions (path, at, touched) of each path after the last that touched it; all, if none did. Two sums, no ordering by path."""
    last = sessions.where("touched").groupBy("path").agg(F.max("at").alias("_last"))
    both = sessions.join(last, "path", "left")
    return both.groupBy("path").agg(F.count_if(F.col("_last").isNull() | (F.col("at") > F.col("_last"))).alias("since"))


def due(last: Column, now: Column, every: str = "24 hours") -> Column:
    """Whether a job that ran last at a time, or never, is to run again."""
    return last.isNull() | (now >= last + F.expr(f"INTERVAL {every}"))


def scheduled(jobs: DataFrame, concurrency: int = 2) -> DataFrame:
    """jobs (id, priority) with position and wave: the highest priority first, then the lowest id, so many at a time."""
    from lodestone.operators.graph import numbered

    placed = numbered(jobs.withColumn("_p", -F.col("priority")), ["_p", "id"], "position").drop("_p")
    return placed.withColumn("wave", F.floor(F.col("position") / concurrency))


def apply_batch(registry: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry (path, sha) after a batch of events, and the mutations (path, kind) it made; same hash, no change."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("type", "sha"), "ts").alias("_x")).select("path", "_x.type", "_x.sha")
    both = registry.withColumnRenamed("sha", "_had").join(last, "path", "full_outer")
    kind = F.when(F.col("type").isNull(), None).when(F.col("type") == "unlink", F.when(F.col("_had").isNotNull(), "DELETE")).when(F.col("_had").isNull(), "CREATE").when(F.col("_had") != F.col("sha"), "UPDATE")
    both = both.withColumn("kind", kind)
    new = both.where((F.col("type").isNull() | (F.col("type") != "unlink")) & F.coalesce("sha", "_had").isNotNull()).select("path", F.coalesce("sha", "_had").alias("sha"))
    return new, both.where("kind is not null").select("path", "kind")


def if_changed(mutations: DataFrame, after: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What after makes of a batch's mutations; where there are none it is not run, and they are returned as they are."""
    made = settled(mutations)
    return made if made.isEmpty() else after(made)


def run_batches(changes: DataFrame, root: str, on_mutations: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A stream that applies each micro-batch to the published registry, atomically, and hands on its mutations.

    A micro-batch that runs again after a stop finds its version published, and only hands on. The whole registry is joined; state.mutations() keeps it
    as keyed state instead.
    """

    def apply(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        before = snapshots.current(spark, root, "registry")
        after, mutations = apply_batch(before, batch)
        snapshots.publish(spark, root, {"registry": after, "mutations": mutations}, version + 1)
        published = snapshots.current(spark, root, "mutations")
        if not published.isEmpty():
            on_mutations(published, version)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def topics(mutations: DataFrame) -> DataFrame:
    """topic, path: every mutation under 'mutation' and under its own kind."""
    both = F.explode(F.array(F.lit("mutation"), F.concat(F.lit("mutation:"), F.lower("kind"))))
    return mutations.select(both.alias("topic"), "path")


class Hooks:
    """Stages by ascending priority; one that fails does not stop the others."""

    def __init__(self):
        self.stages: list[tuple[int, int, str, Callable]] = []

    def register(self, point: str, handler: Callable, priority: int = 50) -> None:
        self.stages.append((priority, len(self.stages), point, handler))

    def run(self, point: str, *args: object) -> dict[str, object]:
        summary = {"ok": 0, "fail": 0, "errors": []}
        for _, _, p, handler in sorted(self.stages, key=lambda s: s[:2]):
            if p == point:
                try:
                    handler(*args)
                    summary["ok"] += 1
                except Exception as e:  # a hook's failure is its own
                    summary["fail"] += 1
                    summary["errors"].append(f"{type(e).__name__}: {e}")
        return summary
