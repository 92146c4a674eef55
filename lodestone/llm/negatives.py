"""Hard negatives by a pivot table.

A score is an inner product q.x. With one more component, sqrt(M^2 - |x|^2) for rows and 0 for anchors (M: the greatest norm), all rows have the
norm M, and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: high scores are short distances. Every row stores its distances to PIVOTS rows; by the triangle
inequality these and the anchor's own bracket the distance between the two, and so the score. Rows of a batch lie in blocks, ordered by
nearest pivot, with the range of their distances to each: a block whose bracket misses what an anchor looks for is passed over, then rows are, and
what survives is scored exactly.

Anchors are searched in chunks of CHUNK, the only thing broadcast, against all rows, in two passes: the best POSITIVES rows of the
anchor's label, and then, for each of these, the best NEGATIVES rows of other labels whose scores lie within its margins. A task keeps that many
a query, whatever its rows; the tasks' lists are merged by query. The second pass begins with what one row in SEED alone gives,
a lower bound for all, so that the lists of tasks are short, however many tasks there are.

Pivots are chosen farthest first among SAMPLE rows of the smallest hashes; which rows they are has no influence on the result.

Rows: a null label, a null vector, a null or non-finite component takes a row out. Vectors of different lengths are filled up with zeros. Rows that repeat an
id are rows each, but an anchor never meets a row of its own id; an id that several rows give to an anchor is one anchor, with the smallest
label, then vector. A null id is no anchor, comes last among ties, and is returned as null. Components are taken up to 2^24 in size (as 256 x; larger
ones count as that). Ties of scores go to the smaller id. Columns beside the three are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import settled

PIVOTS, SAMPLE = 8, 256
POSITIVES, NEGATIVES = 5, 10
#: Anchors that are searched at once, and those of them that are compared with a batch of rows at once.
CHUNK, SIDE = 16_384, 256
#: Rows of a block with one bracket.
BLOCK = 64
#: One row in so many is searched first for a lower bound.
SEED = 16
#: Hundredths of a positive's score within which a negative's lies.
LOWEST, HIGHEST = 30, 90
#: Greatest component.
LARGEST = 1 << 24
#: Stands for a null id in tasks.
NO_ID = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label, v (array of whole numbers as double) of the rows that take part."""
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(256 * c.cast("double")).cast("double"))))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = embeddings.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), "embedding")
    return df.where(F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros to width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Pivots:
    """Distances to pivots in the space where inner products are distances."""

    def __init__(self, vectors: np.ndarray, most: float):
        """vectors: of the sample; most: the greatest norm of all rows, squared."""
        self.most, self.width = most, vectors.shape[1]
        points = self.lifted(vectors)
        chosen = [0] if len(points) else []
        near = np.full(len(points), np.inf)
        while chosen and len(chosen) < min(PIVOTS, len(points)):
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(near.argmax()))
        self.points = points[chosen]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(0, self.most - (rows**2).sum(1)))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted**2).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(0, square))

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        return self.distances(self.lifted(rows))

    def of_anchors(self, anchors: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([anchors, np.zeros((len(anchors), 1))]))

    def scores(self, square: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of anchors (square: of their norms) whose distance from rows is between near and far, with room for rounding."""
        room = 1 + 1e-6 * (square[:, None] + self.most)
        mid = (square[:, None] + self.most) / 2
        return mid - far**2 / 2 - room, mid - near**2 / 2 + room


class Best:
    """The best rows of every query so far: by score, then by id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, -np.inf) if floor is None else floor.astype(np.float64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.r_[True, q[1:] != q[:-1]]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = place < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        full = place == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])


def search(rows: DataFrame, pivots: Pivots, anchors: dict[str, np.ndarray], same: bool, k: int, queries: dict[str, np.ndarray] | None = None) -> DataFrame:
    """query, score, vec_id: of each task, the best k rows of every query.

    anchors: id, label, v. same: rows of the anchor's label, else of others. queries: anchor (its place), lowest and highest score, floor (scores
    below it are not wanted), by anchor; without them every anchor is a query without limits.
    """
    sc = rows.sparkSession.sparkContext
    if queries is None:
        n = len(anchors["id"])
        queries = {"anchor": np.arange(n), "lowest": np.full(n, -np.inf), "highest": np.full(n, np.inf), "floor": np.full(n, -np.inf)}
    sent = sc.broadcast((pivots, anchors, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, anchors, queries = sent.value
        away, square = pivots.of_anchors(anchors["v"]), (anchors["v"] ** 2).sum(1)
        best = Best(len(queries["anchor"]), k, queries["floor"])
        for batch in batches:
            _searched(batch, pivots, anchors, away, square, same, queries, best)
        for at in range(0, len(best.query), 10_000):
            part = slice(at, at + 10_000)
            ids = pa.array(best.id[part], mask=best.id[part] == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(best.query[part]), pa.array(best.score[part]), ids], ["query", "score", "vec_id"])

    return rows.mapInArrow(run, "query long, score long, vec_id long")


def _searched(batch: pa.RecordBatch, pivots: Pivots, anchors: dict, away: np.ndarray, square: np.ndarray, same: bool, queries: dict, best: Best) -> None:
    """Adds what a batch of rows has for the queries to best."""
    if not batch.num_rows or not len(queries["anchor"]):
        return
    rows, table = matrix(batch.column("v"), pivots.width), matrix(batch.column("d"), len(pivots.points))
    ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    labels = batch.column("label").to_numpy(zero_copy_only=False)
    order = np.lexsort((table.min(1), table.argmin(1)))
    rows, table, ids, labels = rows[order], table[order], ids[order], labels[order]
    starts = np.arange(0, len(rows), BLOCK)
    low, high = np.minimum.reduceat(table, starts), np.maximum.reduceat(table, starts)
    of = queries["anchor"]
    for at in range(0, len(away), SIDE):
        q = np.arange(*np.searchsorted(of, [at, at + SIDE]))
        if not len(q):
            continue
        a, its = np.unique(of[q], return_inverse=True)
        low_of, high_of = np.maximum(queries["lowest"][q], best.floor[q]), queries["highest"][q]
        # what any query of an anchor looks for
        wanted_low, wanted_high = np.full(len(a), np.inf), np.full(len(a), -np.inf)
        np.minimum.at(wanted_low, its, low_of)
        np.maximum.at(wanted_high, its, high_of)
        # blocks first: the gap between the anchor's distance and the block's range of distances, to every pivot
        near, far = np.zeros((len(a), len(starts))), np.full((len(a), len(starts)), np.inf)
        for p in range(table.shape[1]):
            own = away[a, p][:, None]
            near = np.maximum(near, np.maximum(low[:, p][None] - own, own - high[:, p][None]))
            far = np.minimum(far, own + high[:, p][None])
        least, most = pivots.scores(square[a], near, far)
        alive = ((most >= wanted_low[:, None]) & (least <= wanted_high[:, None])).any(0)
        j = np.flatnonzero(np.repeat(alive, BLOCK)[: len(rows)])
        if not len(j):
            continue
        # then rows
        near, far = np.zeros((len(a), len(j))), np.full((len(a), len(j)), np.inf)
        for p in range(table.shape[1]):
            own, theirs = away[a, p][:, None], table[j, p][None]
            np.maximum(near, np.abs(own - theirs), out=near)
            np.minimum(far, own + theirs, out=far)
        least, most = pivots.scores(square[a], near, far)
        alive = (most >= wanted_low[:, None]) & (least <= wanted_high[:, None])
        alive &= ((anchors["label"][a][:, None] == labels[j][None]) == same) & (anchors["id"][a][:, None] != ids[j][None])
        # what survives is scored, once for all queries of an anchor: whole sums of products below 2^53 are exact
        exact = np.where(alive, anchors["v"][a] @ rows[j].T, -np.inf)[its]
        alive = (exact >= low_of[:, None]) & (exact <= high_of[:, None]) & (exact > -np.inf)
        if alive.sum() > 4 * best.k * len(q) and len(j) > best.k:
            held = np.where(alive, exact, -np.inf)
            alive &= exact >= np.partition(held, len(j) - best.k, axis=1)[:, len(j) - best.k][:, None]
        x, y = np.nonzero(alive)
        best.add(q[x], exact[x, y].astype(np.int64), ids[j][y])


def merged(found: DataFrame, k: int) -> DataFrame:
    """query, score, vec_id, rank: of all tasks' lists, the best k of every query."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, is_anchor: Column, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor: of vec_id; label: by which to tell rows apart, if not the column of that name.
    """
    spark = embeddings.sparkSession
    rows = settled(prepared(embeddings, label))
    sizes = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    width = max(1, sizes["width"] or 0)
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("v").toArrow()
    pivots = Pivots(matrix(sample.column("v"), width), float(sizes["most"] or 0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.of_rows(matrix(b.column("v"), pivots.width))
            column = pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1], d.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, column], ["vec_id", "label", "v", "d"])

    table = settled(rows.mapInArrow(measured, "vec_id long, label long, v array<double>, d array<double>"))
    own = rows.where(F.col("vec_id").isNotNull() & F.coalesce(is_anchor, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    from lodestone.operators.graph import numbered

    placed = settled(numbered(own, ["vec_id"], "place"))
    n, parts = placed.count(), []
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for at in range(0, n, CHUNK):
        chunk = placed.where(F.col("place").between(at, at + CHUNK - 1)).orderBy("place").select("vec_id", "label", "v").toArrow()
        anchors = {"id": chunk.column("vec_id").to_numpy(), "label": chunk.column("label").to_numpy(), "v": matrix(chunk.column("v"), width)}
        # a row a query: at most CHUNK x POSITIVES, whatever the input
        near = merged(search(table, pivots, anchors, True, POSITIVES), POSITIVES).orderBy("query", "rank").toArrow()
        score, anchor = near.column("score").to_numpy(), near.column("query").to_numpy()
        queries = {"anchor": anchor, "lowest": np.ceil(LOWEST * score / 100), "highest": np.floor(HIGHEST * score / 100), "floor": np.full(len(anchor), -np.inf)}
        if len(anchor):
            seeds = merged(search(table.where(F.pmod(F.xxhash64("vec_id"), F.lit(SEED)) == 0), pivots, anchors, False, NEGATIVES, queries), NEGATIVES)
            floors = seeds.where(F.col("rank") == NEGATIVES).select("query", "score").toArrow()
            queries["floor"][floors.column("query").to_numpy()] = floors.column("score").to_numpy()
        positive = near.column("vec_id").combine_chunks()
        named = pa.table({"query": pa.array(np.arange(len(anchor))), "anchor_id": pa.array(anchors["id"][anchor]), "positive_id": positive, "positive_score": near.column("score").combine_chunks()})
        found = merged(search(table, pivots, anchors, False, NEGATIVES, queries), NEGATIVES).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        if len(anchor):
            parts.append(settled(found.join(F.broadcast(spark.createDataFrame(named)), "query").select(*(x.split()[0] for x in out.split(", ")))))
    if not parts:
        return spark.createDataFrame([], out)
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def registered(embeddings: DataFrame) -> DataFrame:
    """The registered query: anchors are ids divisible by 100; the label of ids divisible by 7 is moved on by one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("vec_id") % 100 == 0, label)
