"""Connected components by contraction.

In every round each node points to the node of the smallest hash among itself and its neighbours, and the links are redrawn
between the nodes pointed to. The image of a connected graph is connected, and about half of the nodes are pointed to, so
rounds are few whatever the shape and the labels (a chain in the order of its labels included), and each costs half of
the one before. What is left within ONE_TASK links, a checked number, is joined up by one task. The pointers are then
followed backwards, from the last, smallest round to the first.

Rows: a link of a node with itself is no link; repeated links and both directions count once; null ends are left out; no links
give an empty result. No node is dropped, however many links it has: its links are summed up before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import settled

#: Links that one task may hold; beyond it, another round.
ONE_TASK = 200_000


def _joined(links: DataFrame, kind: str) -> DataFrame:
    """node, to: a representative of its component, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, batch_type), pa.array([top(x) for x in nodes], batch_type)], ["node", "to"])

    batch_type = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    return links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, to {kind}")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root (the smallest node reachable) of every end of the links (a, b: long, int, string or binary)."""
    kind = links.schema["a"].dataType.simpleString()
    distinct = lambda df: settled(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, pointers = distinct(links), []
    while left.count() > one_task:
        both = left.union(left.select("b", "a")).toDF("node", "near")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(pointers)), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        nearest = both.groupBy("node").agg(F.min(rank("near")).alias("best"))
        pointers.append(settled(nearest.select("node", F.least(rank("node"), "best")["to"].alias("to"))))
        ends = pointers[-1]
        moved = left.join(ends.toDF("a", "a2"), "a").join(ends.toDF("b", "b2"), "b")
        left = distinct(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")))
    last = settled(_joined(left, kind))
    for step in reversed(pointers):
        further = last.toDF("to", "end")
        here = step.join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        last = settled(here)
    smallest = last.groupBy("to").agg(F.min("node").alias("root"))
    return settled(last.join(smallest, "to").select("node", "root"))
