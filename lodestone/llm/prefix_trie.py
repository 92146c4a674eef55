"""Prefix trie of conversations, merged family first.

A family is a base conversation and those rebuilt from it. A conversation's turns are reduced to digests of role and text, and to numbers of words, before
anything is shuffled; families are then brought together, base first, and each family's trie is built as its rows stream by: a node is the
digest of its parent's digest and its turn, and carries the members that go through it. Only these combined nodes go on, to be merged over all
families by digest.

Sums over subtrees need no pass up the levels. The members of a node, with the words from the node's depth to their ends, give the sum of
n_convs times words below it. Of every node the smallest member is the owner; what a conversation owns is the end of its path, from some depth on,
for whoever is the smallest member of a node is that of all below it on its path. So below a node of owner c lie the rest of what c
owns, and all that its other members own: running sums by owner, and a sum by node over its members, give the words and the leaves of the subtree.

Rows: a null role or text is an empty one; a null turn comes first, turns that tie are ordered by the digest of role and text, and rows that repeat are turns
each; rows without a conv_id belong to no conversation and are left out; other columns are left out, whatever they are called. An
empty table has no conversation and no root: the result is empty. Texts may be of any length, a conversation of any number of turns: a family's
nodes are handed on whenever they hold FLUSH members, and merged again with the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ASCII_SPACE, settled

#: Conversations of a family, and the greatest number of turns that one takes from its base, plus one.
FAMILY, HEADS = 20, 4
#: Members of nodes that a task holds at once; between families, a tenth.
FLUSH = 50_000
#: Ids that are joined to one piece of text before they are hashed.
PIECE = 10_000
ROOT = b"\0" * 16
NODE = "node binary, parent binary, depth long, words long, below long, members array<long>, ends array<long>"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, base, turn, key (digest of role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    words = F.size(F.array_remove(F.split(text, "[" + "".join(f"\\x{ord(c):02x}" for c in ASCII_SPACE) + "]+"), "")).cast("long")
    c = F.col("conv_id").cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(c.alias("conv_id"), (c - c % FAMILY).alias("base"), F.col("turn").cast("long").alias("turn"), key.alias("key"), words.alias("words"))


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def families(each: DataFrame) -> DataFrame:
    """turns() with h (turns taken from the base; a base itself takes none), i (place in the conversation, from 1) and own (words of
    its turns behind the first h), family by family, base first."""
    order = Window.partitionBy("base", "_later", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "key", "words")
    later = F.col("conv_id") != F.col("base")
    df = each.withColumns({"_later": later, "h": F.when(later, heads(F.col("conv_id"))).otherwise(0)})
    df = df.repartition("base").withColumn("i", F.row_number().over(order))
    own = F.sum(F.when(F.col("i") > F.col("h"), F.col("words")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("own", own).select("base", "conv_id", "h", "i", "key", "words", "own")


class _Trie:
    """Nodes of one family, as far as they are held: node, parent, depth, words, below, members, ends."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.held = 0

    def full(self, limit: int) -> bool:
        return self.held > limit

    def at(self, place: tuple) -> list:
        held = self.nodes.get(place[0])
        if held is None:
            held = self.nodes[place[0]] = [*place, 0, [], []]
        return held

    def add(self, place: tuple, below: int, conv: int) -> None:
        held = self.at(place)
        held[4] += below
        held[5].append(conv)
        self.held += 1

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = list(zip(*self.nodes.values())) or [()] * len(kinds)
        self.nodes, self.held = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in NODE.split(", ")])


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Family nodes of rows in the order of families(). Of a base only the first turns are remembered."""
    trie = _Trie()
    base = conv = place = None
    head: list[tuple[bytes, int]] = []
    left = 0

    def step(key: bytes | None, words: int) -> None:
        """On to the next node of the conversation, or to the root."""
        nonlocal place, left
        if key is None:
            place = (ROOT, None, 0, 0)
        else:
            place = (hashlib.blake2b(place[0] + key, digest_size=16).digest(), place[0], place[2] + 1, words)
        trie.add(place, left, conv)
        left -= words

    for batch in batches:
        for b, c, h, i, key, words, own in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if c != conv:
                if place is not None:
                    trie.at(place)[6].append(conv)
                if b != base:
                    base, head = b, []
                    if trie.full(FLUSH // 10):
                        yield trie.batch()
                conv, left = c, own + sum(w for _, w in head[:h])
                step(None, 0)
                for k, w in head[:h]:
                    step(k, w)
            if c == base and i < HEADS:
                head.append((key, words))
            if i > h:
                step(key, words)
            if trie.full(FLUSH):
                yield trie.batch()
    if place is not None:
        trie.at(place)[6].append(conv)
    yield trie.batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256 of pieces (node, first, text) in order, as they stream by."""
    node, digest, out = None, None, []
    for batch in batches:
        for n, _, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if n != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if len(out) > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["node", "ends_sha256"])
            out = []
    if node is not None:
        out.append((node, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["node", "ends_sha256"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, first, text: ids (node, conv_id) in order, joined by commas, PIECE at most to a row."""
    for batch in batches:
        out: list[tuple] = []
        nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        for i in range(1, len(nodes) + 1):
            if i == len(nodes) or nodes[i] != nodes[start] or i - start == PIECE:
                out.append((nodes[start], ids[start], ",".join(map(str, ids[start:i]))))
                start = i
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["node", "first", "text"])


def end_digests(nodes: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes at which conversations end.

    The ids are sorted by ranges and joined to pieces there; only hashing a node's pieces is one task's work, which holds one piece at a time.
    """
    ends = nodes.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv_id"))
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node binary, first long, text string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = settled(families(turns(conversations)).mapInArrow(_built, NODE))
    sums = (F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.sum("below").alias("below"))
    merged = nodes.select("node", "parent", "depth", "words", "below", F.array_min("members").alias("owner"), F.size("members").alias("n"))
    merged = settled(merged.groupBy("node").agg(*sums, F.min("owner").alias("owner"), F.sum("n").cast("long").alias("n_convs")))
    children = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = merged.join(children, "node", "left").na.fill(0, ["n_children"])
    # what an owner has: from the depth of its first node to the end of its path
    rest = Window.partitionBy("owner").orderBy(F.desc("depth"))
    tree = settled(tree.withColumn("rest", F.sum("words").over(rest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("leaf", F.sum((F.col("n_children") == 0).cast("long")).over(rest.rowsBetween(Window.unboundedPreceding, 0))))
    owned = tree.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("_from"), F.max("rest").alias("_words"), F.max("leaf").alias("_leaves"))
    paths = nodes.select("node", "depth", F.explode("members").alias("conv_id"))
    others = paths.join(owned, "conv_id").where(F.col("depth") < F.col("_from")).groupBy("node").agg(F.sum("_words").alias("_words"), F.sum("_leaves").alias("_leaves"))
    parents = tree.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    full = tree.join(others, "node", "left").join(end_digests(nodes), "node", "left").join(parents, "parent", "left")
    return full.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaf") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("below") - F.col("rest") - F.coalesce("_words", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
