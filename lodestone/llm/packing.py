"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens, its documents in order. In every round each queue with tokens left is granted its
share of a window; the fraction of a token that it could not spend is its deficit and is carried to the next round,
over windows and partitions alike. Rounds are laid end to end and cut into windows, so all windows but the last are
full.

The deficits have a closed form, which is what lets partitions work alone: with weight w and T tokens, a queue has sent
floor(min(T, w * tau)) tokens once tau of virtual time has passed, and round r ends at the tau at which all queues
together have sent r windows. A queue that runs dry leaves its share to the others. A document needs only its place in
its queue and the table of queues (at most MAX_QUEUES rows) to know where all its tokens go.

The place in the queue is a prefix sum in two steps: documents are dealt to blocks by id and tokens, a block of a queue is
ordered by id, and the blocks of a queue are summed up. No task sees a whole queue.

Rows: null text counts as empty (a document is then its end id alone); a null source is a queue of its own; repeated
rows are documents each (ties of an id are ordered by their tokens); other columns are left out, whatever they are
called; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, partitions, small_batches

#: With more sources than this, sources share queues, and take turns in them.
MAX_QUEUES = 1024
_PLAIN = re.compile("[^\x00-ɏ -⁯₠-₿℀-⅏←-⋿]")


class Ids:
    """Token ids of a vocabulary file. Plain texts take the same vocabulary's rank file, if given: same ids, sooner."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = re.compile("|".join(re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.quick = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        if self.quick and not _PLAIN.search(text) and not self.special.search(text):
            return self.quick(text)
        return self.library.encode(text, add_special_tokens=False).ids


_ids: dict[tuple, Ids] = {}


def ids_of(*key) -> Ids:
    if key not in _ids:
        _ids[key] = Ids(*key)
    return _ids[key]


class Rounds:
    """Where the tokens of each queue go. tokens, weights: by queue."""

    def __init__(self, tokens: np.ndarray, weights: np.ndarray, length: int):
        self.tokens, self.weights, self.length = tokens.astype(np.float64), weights.astype(np.float64), length
        self.total = int(tokens.sum())
        self.last = -(-self.total // length)
        dry = np.unique(np.concatenate([[0.0], self.tokens / self.weights]))
        self.tau, self.sent_by = dry, np.array([np.minimum(self.tokens, self.weights * t).sum() for t in dry])

    def sent(self, queue: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Tokens that a queue has sent before round r; queue and r are of shapes that fit each other."""
        tau = np.interp(r * float(self.length), self.sent_by, self.tau)
        t = self.tokens[queue]
        return np.where(r >= self.last, t, np.where(r <= 0, 0, np.floor(np.minimum(t, self.weights[queue] * tau)))).astype(np.int64)

    def round_of(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The round in which a queue sends its token number at."""
        tau = (at + 0.5) / self.weights[queue]
        r = np.clip((np.interp(tau, self.tau, self.sent_by) // self.length).astype(np.int64), 0, max(0, self.last - 1))
        while (over := self.sent(queue, r) > at).any():
            r = r - over
        while (under := self.sent(queue, r + 1) <= at).any():
            r = r + under
        return r

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents at first in their queue, n tokens long: row, start in the document, length, place in all."""
        lo, hi = self.round_of(queue, first), self.round_of(queue, first + n - 1)
        row = np.repeat(np.arange(len(n)), hi - lo + 1)
        r = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[row]
        q = queue[row]
        begin, end = self.sent(q, r), self.sent(q, r + 1)
        a, b = np.maximum(begin, first[row]), np.minimum(end, (first + n)[row])
        place = np.empty(len(row), np.int64)
        queues = np.arange(len(self.tokens))[:, None]
        step = max(64, (1 << 20) // len(self.tokens))  # rows at a time: about 8 MB a table of queues by rounds
        for k in range(0, len(row), step):
            at, back = np.unique(r[k : k + step], return_inverse=True)
            before, after = self.sent(queues, at[None, :]), self.sent(queues, at[None, :] + 1)
            granted = after - before
            start = before.sum(0)[None, :] + np.cumsum(granted, 0) - granted
            place[k : k + step] = start[q[k : k + step], back]
        place += a - begin
        keep = b > a
        row, a, b, place = row[keep], a[keep], b[keep], place[keep]
        w0, w1 = place // self.length, (place + b - a - 1) // self.length  # cut at the ends of windows
        again = np.repeat(np.arange(len(row)), w1 - w0 + 1)
        w = np.arange(len(again)) - np.repeat(np.cumsum(w1 - w0 + 1) - (w1 - w0 + 1), w1 - w0 + 1) + w0[again]
        s = np.maximum(place[again], w * self.length)
        e = np.minimum((place + b - a)[again], (w + 1) * self.length)
        return row[again], (a - first[row])[again] + s - place[again], e - s, s


def _taking_turns(made: DataFrame, weighted: bool, most: int) -> DataFrame:
    """made with turn and block for queues that sources share: deficit round-robin by whole documents.

    A document's turn is the virtual time at which its source, alone served by its weight (without weights, by its share), has sent
    what is before it. In the order of turns each source of a queue has its part of what the queue sends, up to a document. A queue's
    turns are dealt out to blocks by ranges.
    """
    key = [F.coalesce(F.xxhash64("source"), F.lit(0)).alias("_s"), F.col("source").isNull().alias("_null")]
    made = made.select("*", *key)
    parts = made.groupBy("queue", "_s", "_null", "_weight", "block").agg(F.sum("n").alias("_in"))
    whole = Window.partitionBy("queue", "_s", "_null")
    upto = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    speed = F.col("_weight") if weighted else F.col("_all").cast("double")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in").over(upto), F.lit(0))).withColumn("_all", F.sum("_in").over(whole)).withColumn("_speed", speed)
    last = parts.groupBy("queue").agg(F.max(F.col("_all") / F.col("_speed")).alias("_last"))
    parts = cut(parts.join(F.broadcast(last), "queue").select("queue", "_s", "_null", "block", "_before", "_speed", "_last"))  # MAX_QUEUES rows
    within = Window.partitionBy("queue", "_s", "_null", "block").orderBy("doc_id", "n", "ids").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(within), F.lit(0))
    placed = made.withColumn("_first", first).join(parts, ["queue", "_s", "_null", "block"])
    placed = placed.withColumn("turn", (F.col("_before") + F.col("_first")) / F.col("_speed"))
    block = F.least(F.floor(F.col("turn") / F.col("_last") * most), F.lit(most - 1))
    return placed.select("doc_id", "queue", "n", "ids", block.alias("block"), "turn")


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, weights: Mapping[str | None, float] | None = None, ranks: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source queue and (with_ids) the ids.

    weights: of tokens by source; without, each source's share of all tokens, so that all queues last to the end.
    A source not named in weights counts 1. With more than MAX_QUEUES sources, the MAX_QUEUES / 2 of the greatest weights
    have queues of their own; the others share queues, each of the weight of its sources together, in which they take turns by whole
    documents: their parts are held as well, up to a document's length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", "source")
    names = [r[0] for r in docs.select("source").distinct().limit(MAX_QUEUES + 1).collect()]
    shared, kind = len(names) > MAX_QUEUES, docs.schema["source"].dataType.simpleString()
    source_kind = kind
    names = sorted((x for x in names if x is not None)) + [None] * (None in names)
    if shared:
        # the sources that weigh most keep queues of their own; a queue shared by others weighs as much as they do together
        heavy = sorted(weights or {}, key=lambda x: (-weights[x], x is None, x or ""))[: MAX_QUEUES // 2]
        hashed = (F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES - len(heavy))) + len(heavy)).cast("int")
        own = {x: i for i, x in enumerate(heavy)}
        table = spark.createDataFrame([(own.get(x), x, float(w)) for x, w in (weights or {}).items()], f"_own int, _source {kind}, _weight double")
        queued = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")), "left")  # a row a weight given
        queued = queued.select("doc_id", "text", "source", F.coalesce("_own", hashed).alias("_queue"), F.coalesce("_weight", F.lit(1.0)).alias("_weight"))
    else:
        table = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"_queue int, _source {kind}")
        queued = docs.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")))  # at most MAX_QUEUES rows
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(vocabulary, ranks, pattern)
        for b in batches:
            got = [np.array([*ids(t.as_py() or ""), end_id], "<u4") for t in b.column(1)]
            n = pa.array([len(x) for x in got], pa.int64())
            rest = [b.column(i) for i in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n, pa.array([(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in got], pa.binary()), *rest], ["doc_id", "queue", "n", "ids", *b.schema.names[3:]])

    dealt = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(4 * partitions(spark)))  # rows that share an id, or have none, are spread as well
    made = queued.select("doc_id", "text", F.col("_queue").alias("queue"), *(["source", "_weight"] if shared else [])).mapInArrow(tokenize, f"doc_id {kind}, queue int, n long, ids binary" + f", source {source_kind}, _weight double" * shared)
    if shared:
        made = cut(_taking_turns(cut(made.withColumn("block", dealt)), weights is not None, 4 * partitions(spark)))
    else:
        made = cut(made.withColumn("block", dealt).withColumn("turn", F.lit(0.0)))
    blocks = made.groupBy("queue", "block").agg(F.sum("n").alias("in_block"))
    upto = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(blocks.withColumn("before", F.coalesce(F.sum("in_block").over(upto), F.lit(0))))
    sums = {r[0]: r[1] for r in blocks.groupBy("queue").agg(F.sum("in_block")).collect()}  # a row a queue
    tokens = np.array([sums.get(q, 0) for q in range(max(sums, default=0) + 1)], np.int64)
    if weights is None:
        share = np.maximum(tokens, 1).astype(np.float64)
    elif shared:
        summed = queued.select("source", "_queue", "_weight").distinct().groupBy("_queue").agg(F.sum("_weight")).collect()  # a row a queue
        share = np.ones(len(tokens))
        for q, w in summed:
            share[q] = w
    else:
        share = np.array([float(weights.get(names[q], 1.0)) for q in range(len(tokens))])
    rounds = Rounds(tokens, share, length)

    within = Window.partitionBy("queue", "block").orderBy("turn", "doc_id", "n", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks.drop("in_block"), ["queue", "block"])
    placed = placed.select("doc_id", "queue", (F.col("first") + F.col("before")).alias("first"), "n", "ids")

    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int" + ", ids array<int>" * with_ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            queue, first, n = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            row, start, size, place = rounds.pieces(queue, first, n)
            whole = [np.frombuffer(x.as_py(), "<u2" if len(x.as_py()) == 2 * k else "<u4").astype("<u4") for x, k in zip(b.column(4), n)]
            parts = [whole[i][s : s + k] for i, s, k in zip(row, start, size)]
            out = [b.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array(n[row]), pa.array(place // length), pa.array(place % length), pa.array(queue[row])]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in columns.split(", ")])

    return placed.mapInArrow(split, columns)
