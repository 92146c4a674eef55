"""Line deduplication by range-partitioned line hashes.

The hashes of all lines, with document and position, are partitioned by range of (hash, document) and sorted by
(hash, document, position), so that one pass over a partition meets each hash's documents in order and can tell first
occurrences; a line that very many documents share is spread over several ranges. The documents of a hash are then
counted from the first occurrences alone, summed up in each partition before they are shuffled. What comes back for a
document is not its text but a run-end coded bitmap of the lines it keeps.

DataFrame operations only. Hashes are 128 bits wide (two differently seeded 64-bit hashes).

Rows: null and empty texts are one empty line; a document is known by its doc_id (null is a value like others), so
repeated rows count once towards a line's documents; bitmaps are of distinct rows, and with_bitmaps() gives every row its own;
empty keys (below min_chars) are never dropped; other columns are left out, whatever they are called, but those that
with_bitmaps() is told to keep; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ASCII_SPACE, ascii_lower, cut, let, partitions

#: Up to this many dropped hashes (16 bytes each) are broadcast; beyond it, the join shuffles.
BROADCAST_HASHES = 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of every line: without ASCII white space at both ends, A-Z in lower case (of the whole text at once)."""
    return F.transform(lines_of(ascii_lower(text)), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))


def _bitmap(dropped: Column, n: Column) -> Column:
    """Ends of the runs of kept and dropped lines in turn, the first kept (it can be empty), of n lines.

    dropped: sorted positions. Every array is bound once: named inside a lambda, it would be made anew for each element.
    """

    def runs(at: Column) -> Column:
        size = F.size(at)
        starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(at, i) != F.get(at, i - 1) + 1))
        ends = lambda s: F.transform(s, lambda i, k: F.array(F.get(at, i), F.get(at, F.coalesce(F.get(s, k + 1), size) - 1) + 1))
        return F.concat(F.flatten(let(starts, ends)), F.array(n))

    return F.when(F.size(dropped) > 0, let(dropped, runs)).otherwise(F.array(n))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The lines that each document keeps when all lines are dropped whose key stands in min_docs documents or more.

    Returns, for every distinct pair of doc_id and text, doc_id, text_hash (xxhash64 of the text), n_lines, n_dropped and
    keep, the bitmap. No text is shuffled.
    """
    spark = docs.sparkSession
    # what the texts give is kept before it is dealt out by range: the ranges are found by a pass of their own
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), line_keys(F.coalesce("text", F.lit(""))).alias("keys"))
    hashed = F.transform("keys", lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    docs = cut(docs.select("doc_id", "t", hashed.alias("keys")))
    lines = docs.select("doc_id", "t", F.posexplode("keys").alias("pos", "key")).where(F.col("key").isNotNull()).select("key.h1", "key.h2", "doc_id", "t", "pos")
    ranged = lines.repartitionByRange(partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "t", "pos")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("t", "pos"))  # streams over the sorted ranges
    ranged = cut(ranged.withColumn("first", nth == 1))
    counts = ranged.where("first").groupBy("h1", "h2").agg(F.count("*").alias("docs"))
    common = cut(counts.where(F.col("docs") >= min_docs).select("h1", "h2"))
    few = common.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    hits = ranged.join(F.broadcast(common) if few else common, ["h1", "h2"], "left_semi")
    # a row with the line count of each document beside those of its dropped lines: one grouping gives both
    sizes = docs.select("doc_id", "t", F.size("keys").alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    rows = sizes.unionByName(hits.select("doc_id", "t", F.lit(None).cast("int").alias("n_lines"), "pos"))
    grouped = rows.groupBy("doc_id", "t").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("dropped"))
    return grouped.select("doc_id", F.col("t").alias("text_hash"), F.col("n_lines").cast("long"), F.size("dropped").cast("long").alias("n_dropped"), _bitmap(F.col("dropped"), F.col("n_lines")).alias("keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and the columns named, with n_lines, n_dropped and keep of each document.

    Here texts do move, once: a bitmap is known only after all documents were counted.
    """
    left = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *columns).alias("more"), F.xxhash64("text").alias("t")).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t") == F.col("b.text_hash"))
    joined = left.join(bitmaps.alias("b"), same)
    return joined.select("a.doc_id", "a.text", *(F.col("a.more")[c].alias(c) for c in columns), "b.n_lines", "b.n_dropped", "b.keep")


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined again: whole runs of lines at a time."""

    def cut_out(lines: Column) -> Column:
        runs = F.filter(F.transform(keep, lambda end, i: F.struct((i % 2 == 0).alias("keep"), F.coalesce(F.get(keep, i - 1), F.lit(0)).alias("at"), end.alias("end"))), lambda r: r["keep"] & (r["at"] < r["end"]))
        return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["at"] + 1, r["end"] - r["at"]))), "\n")

    return F.when(F.size(keep) <= 1, F.coalesce(text, F.lit(""))).otherwise(let(lines_of(text), cut_out))
