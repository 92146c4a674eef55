"""Values that flow along edges, by eliminating nodes.

Every node has a value of its own, or none; its final value is the greatest of that and of what comes along its edges, the weight of an edge plus the
final value of where it leads: value(v) = max(own(v), w(v, d) + value(d)). Longest chains (levels, critical paths) are of this form,
and, with all weights 0, what reaches a set of nodes. With a merging of sketches in place of the maximum, and no weights, so are sets of ancestors.

A round eliminates nodes no two of which are neighbours: ends, beginnings, and nodes with one edge in or one out. An edge into such a node is joined with
each of its edges out, and its own value is carried to where its edges come from; so edges never grow in number, and a chain, a tree or what is made of
such in series and parallel is gone after about log n rounds, where a round a level takes as many as the longest path. What is left within local_edges, a
checked number, is solved by one task, with the same result. The eliminated nodes then get their values in reverse order, each from edges to nodes that
have theirs.

Rows: edges of a node with itself are left out; of parallel edges the heaviest counts; edges at nodes without a row in own are as any others; no edges: every
node keeps its own value. Nodes on or behind a cycle have the value CYCLIC if weights count; with all weights 0 cycles do no harm.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import settled

#: Edges that one task may solve.
LOCAL_EDGES = 1_000_000
#: The value of nodes on or behind a cycle, where weights count.
CYCLIC = float(1 << 50)
#: A round that eliminates fewer of the nodes than one in so many is the last: what is left goes step by step.
FEW = 50


def solved(src: np.ndarray, dst: np.ndarray, w: np.ndarray, node: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and final values, in memory: from the ends backwards; what is left lies on or behind cycles."""
    names = np.unique(np.concatenate([src, dst, node]))
    a, b = np.searchsorted(names, src), np.searchsorted(names, dst)
    value = np.full(len(names), -np.inf)
    value[np.searchsorted(names, node)] = own
    order = np.argsort(b, kind="stable")
    into, weight = a[order].tolist(), w[order].tolist()
    first = np.searchsorted(b[order], np.arange(len(names) + 1)).tolist()
    waits = np.bincount(a, minlength=len(names))
    ready = np.flatnonzero(waits == 0).tolist()
    waits, v = waits.tolist(), value.tolist()
    while ready:
        n = ready.pop()
        for k in range(first[n], first[n + 1]):
            u = into[k]
            v[u] = max(v[u], weight[k] + v[n])
            waits[u] -= 1
            if not waits[u]:
                ready.append(u)
    left = [n for n, k in enumerate(waits) if k]
    if left and any(weight):
        for n in left:
            v[n] = CYCLIC
    elif left:
        heap = [(-v[n], n) for n in left]
        heapq.heapify(heap)
        done = set()
        while heap:
            x, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            for k in range(first[n], first[n + 1]):
                u = into[k]
                if v[u] < -x:
                    v[u] = -x
                    heapq.heappush(heap, (x, u))
    return names, np.array(v)


def _by_one_task(edges: DataFrame, own: DataFrame) -> DataFrame:
    """node_id, value of all nodes of the edges, of which there are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())]))
        src, dst, w = (held.column(k).combine_chunks() for k in range(3))
        pair = dst.is_valid().to_numpy(zero_copy_only=False)
        src, dst, w = src.to_numpy(zero_copy_only=False), dst.fill_null(0).to_numpy(zero_copy_only=False), w.fill_null(-np.inf).to_numpy(zero_copy_only=False)
        names, values = solved(src[pair], dst[pair], w[pair], src[~pair], w[~pair])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, mask=np.isneginf(values))], ["node_id", "value"])

    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    known = own.join(ends, "node_id", "left_semi").select(F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("value").cast("double").alias("w"))
    rows = edges.select("src", "dst", F.col("w").cast("double").alias("w")).unionByName(known)
    return rows.coalesce(1).mapInArrow(run, "node_id long, value double")


def _chosen(e: DataFrame, turn: int) -> DataFrame:
    """node_id of an independent set of nodes that are cheap to eliminate: of cheap neighbours, ends and beginnings go first, else the one of the smallest hash."""
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("o"))
    into = e.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("i"))
    cheap = settled(out.join(into, "node_id", "full_outer").na.fill(0).select("node_id", F.least("o", "i").alias("k")).where("k <= 1"))
    rank = lambda c: F.struct(F.col(f"k_{c}"), F.xxhash64(F.lit(turn), c), F.col(c))
    both = e.join(cheap.toDF("src", "k_src"), "src").join(cheap.toDF("dst", "k_dst"), "dst")
    losers = both.select(F.when(rank("src") > rank("dst"), F.col("src")).otherwise(F.col("dst")).alias("node_id")).distinct()
    return settled(cheap.select("node_id").join(losers, "node_id", "left_anti"))


def _spread(e: DataFrame, own: DataFrame, merge: Callable[[Column], Column], along: Callable[[Column, Column], Column]) -> DataFrame:
    """node_id, value, step by step along the edges of what could not be eliminated, until nothing changes; for merges that may repeat."""
    value = settled(own)
    while True:
        comes = e.join(value.withColumnsRenamed({"node_id": "dst", "value": "_v"}), "dst").where(F.col("_v").isNotNull()).select(F.col("src").alias("node_id"), along(F.col("w"), F.col("_v")).alias("value"))
        after = settled(value.withColumn("_old", F.lit(True)).unionByName(comes.withColumn("_old", F.lit(False))).groupBy("node_id").agg(merge(F.col("value")).alias("value")))
        moved = after.join(value.withColumnRenamed("value", "_v"), "node_id").where(~F.col("value").eqNullSafe(F.col("_v"))).isEmpty()
        value = after
        if moved:
            return value


def flow(edges: DataFrame, own: DataFrame, merge: Callable[[Column], Column] = F.max, along: Callable[[Column, Column], Column] = lambda w, v: w + v, local_edges: int | None = None) -> DataFrame:
    """node_id, value of the nodes of own (node_id, value; null: none of its own), over edges (src, dst, w).

    merge: an aggregate that may see a value twice (a maximum, a union); along: what comes along an edge. With local_edges 0, which merges other than the
    maximum need, no part is solved by one task.
    """
    local_edges = LOCAL_EDGES if local_edges is None else local_edges
    kind = own.schema["value"].dataType
    e = settled(edges.where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w")))
    lone = own.join(e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct(), "node_id", "left_anti").select("node_id", "value")
    ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    value = settled(ends.join(own.select("node_id", "value"), "node_id", "left"))
    gone: list[tuple[DataFrame, DataFrame]] = []
    turn, n, final = 0, e.count(), None
    while n > local_edges:
        out = _chosen(e, turn)
        if out.count() * FEW < value.count():
            break
        src, dst = out.withColumnRenamed("node_id", "src"), out.withColumnRenamed("node_id", "dst")
        from_out, to_out = settled(e.join(src, "src", "left_semi").select("src", "dst", "w")), settled(e.join(dst, "dst", "left_semi").select("src", "dst", "w"))
        held = settled(value.join(out, "node_id", "left_semi"))
        pushed = to_out.join(held.withColumnsRenamed({"node_id": "dst", "value": "_v"}), "dst").where(F.col("_v").isNotNull()).select(F.col("src").alias("node_id"), along(F.col("w"), F.col("_v")).cast(kind).alias("value"))
        through = to_out.withColumnsRenamed({"dst": "mid", "w": "w1"}).join(from_out.withColumnsRenamed({"src": "mid", "w": "w2"}), "mid").where("src <> dst").select("src", "dst", (F.col("w1") + F.col("w2")).alias("w"))
        rest = e.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select("src", "dst", "w")
        value = settled(value.join(out, "node_id", "left_anti").unionByName(pushed).groupBy("node_id").agg(merge(F.col("value")).alias("value")))
        e = settled(rest.unionByName(through).groupBy("src", "dst").agg(F.max("w").alias("w")))
        gone.append((held, from_out))
        n, turn = e.count(), turn + 1
    if n > local_edges:
        final = _spread(e, value, merge, along)
    elif n:
        rest = value.join(e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct(), "node_id", "left_anti")
        final = settled(_by_one_task(e, value).withColumn("value", F.col("value").cast(kind)).unionByName(rest))
    else:
        final = value
    for held, from_out in reversed(gone):
        comes = from_out.join(final.withColumnsRenamed({"node_id": "dst", "value": "_v"}), "dst").where(F.col("_v").isNotNull()).select(F.col("src").alias("node_id"), along(F.col("w"), F.col("_v")).cast(kind).alias("value"))
        back = held.unionByName(comes).groupBy("node_id").agg(merge(F.col("value")).alias("value"))
        final = settled(final.unionByName(back))
    return lone.unionByName(final.join(own.select("node_id"), "node_id", "left_semi").select("node_id", "value"))


def reached(edges: DataFrame, seeds: DataFrame, outbound: bool = True, local_edges: int | None = None) -> DataFrame:
    """node_id of the seeds (node_id) and of all that they reach (inbound: that reach them), along edges of any depth in few rounds."""
    a, b = ("dst", "src") if outbound else ("src", "dst")
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(0.0).alias("w"))
    nodes = e.select(F.col("src").alias("node_id")).union(e.select("dst")).union(seeds.select("node_id")).distinct()
    own = nodes.join(seeds.select("node_id", F.lit(1.0).alias("value")).distinct(), "node_id", "left")
    return flow(e, own, local_edges=local_edges).where(F.col("value").isNotNull()).select("node_id")

