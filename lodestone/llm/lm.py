"""A log-bilinear language model trained with noise-contrastive estimation, its vocabulary factored into classes.

Vocabulary: all tokens that occur LEAST times or more, up to the VOCABULARY most frequent ones, have vectors of their own, as
context and as target: it grows with the input until it fills a worker's share of memory (35 numbers a token). All others are one
class, within which a token has its smoothed share of the class's count; those counts grow without a bound, in the cluster.

Classes: the SINGLE most frequent tokens are a class each. Every other token gets a profile, its neighbours among those,
projected to PROFILE numbers; profiles are clustered, and each cluster is cut into classes by frequency. With V tokens there are
about the square root of V classes of as many tokens. The state after tokens x (one back) and y (two back) is
h = p1 * R[x] + p2 * R[y]; the probability of token w is that of its class, exp(h . C[class] + b) over the sum for all classes, times that
of the token within it, exp(h . Q[w] + b) over the sum for the tokens of the class: products of matrices, normalised exactly.

Training: a start is fitted on the driver on about WARM_UP documents, chosen by a hash; from there every partition makes one
pass over all its training tokens. Classes are told from noise classes that a minibatch shares, a token from noise tokens of its
class. The model is the mean of the partitions' parameters, a token's weighted by how often a partition met it: sums by
block, in two steps in the cluster; the driver receives one model.

Counts of the most frequent tokens, TOP at most, are broadcast (16 bytes each); the rarer tokens of a document are joined to the
table of counts by hash. Tokens are known by 64-bit hashes.

Rows: null and empty texts are the end token alone; a document whose doc_id is null is learned from; repeated rows
count and are scored each; other columns are left out, whatever they are called; with no training document all counts
are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, small_batches
from lodestone.llm.minhash import _groups, _utf8, word_hashes

LEAST, VOCABULARY, SINGLE, PROFILE = 3, 1 << 16, 64, 16
#: ROWS of a table of scores at a time: they fit a processor's cache.
DIMENSIONS, BATCH, RATE, ROWS = 16, 8192, 0.1, 512
#: Noise classes to a token, in expectation: the EXACT most frequent count by their probability, NOISE draws stand for the rest;
#: so do OWN noise tokens for those of a token's class.
RATIO, EXACT, NOISE, OWN, DAMPING = 16.0, 40, 40, 16, 1e-7
#: Documents of the start, about, each of at most WARM_CHARS characters; counts that are broadcast, VOCABULARY of them at least.
WARM_UP, WARM_CHARS, TOP = 1000, 1 << 16, 1 << 17
#: Rows of a block of parameters; tokens that one partition learns from.
BLOCK, SHARD = 4096, 5_000_000
#: Ids (and classes) of all other tokens and of the end; the end also stands before the first token.
OTHER, END = 0, 1
END_HASH = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text starts (one more than texts)."""
    word, at = word_hashes(texts)
    n = np.diff(at) + 1
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(start[-1], np.uint64)
    ends = start[1:] - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = word, END_HASH
    return out, start


def token_counts(docs: DataFrame) -> DataFrame:
    """h, c: tokens of all texts of docs and how often they occur."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        new: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            texts = _utf8(b.column(0))
            for x, y in _groups(texts, 4 << 20):
                new.append(np.unique(token_hashes(texts[x:y])[0], return_counts=True))
            if sum(len(p[0]) for p in new) > 1_000_000:
                h, c = merge([(h, c), *new])
                new = []
            if len(h) > 3_000_000:  # a bound of memory: what is left is summed up in the cluster
                yield from _rows(h, c)
                h, c = h[:0], c[:0]
        if new or len(h):
            yield from _rows(*merge([(h, c), *new]))

    def _rows(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 100_000].view(np.int64)), pa.array(c[k : k + 100_000])], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Listed:
    """The ids of listed tokens. Hashes are even, so that their first bits find the place in the sorted list but for a few steps."""

    def __init__(self, words: np.ndarray, ids: np.ndarray):
        order = np.argsort(words)
        self.words, self.ids = words[order], ids[order]
        self.shift = np.uint64(64 - min(20, max(1, 3 + len(words).bit_length())))
        first = (self.words >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(first, np.arange((1 << int(64 - self.shift)) + 1))
        self.steps = int(np.diff(self.begin).max())

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """The id of each token, OTHER of those not listed."""
        at, out = self.begin[(tokens >> self.shift).astype(np.int64)], np.zeros(len(tokens), np.int64)
        for k in range(self.steps):
            near = np.minimum(at + k, len(self.words) - 1)
            np.copyto(out, self.ids[near], where=self.words[near] == tokens)
        return out


def neighbours(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before each."""
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[start[:-1]] = END
    two[start[:-1]] = END
    second = start[:-1] + 1
    two[second[second < start[1:]]] = END
    return one, two


def classes_of(counts: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """The class of every id, from the counts by id (OTHER, END, then by frequency) and profiles by id."""
    k, single = len(counts), min(len(counts), SINGLE)
    out = np.arange(k, dtype=np.int32)
    rest = k - single
    if not rest:
        return out
    n = max(1, int(np.sqrt(rest)))
    x = profiles[single:] / np.maximum(np.linalg.norm(profiles[single:], axis=1, keepdims=True), 1e-9)
    groups = min(n, 48)
    rng = np.random.default_rng(11)
    centre = x[rng.choice(rest, groups, replace=False)]
    for _ in range(12):  # k-means on the sphere
        own = np.concatenate([(x[i : i + 65_536] @ centre.T).argmax(1) for i in range(0, rest, 65_536)])
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    order = np.lexsort((np.arange(rest), own))  # by cluster, within it by frequency
    size, place = -(-rest // n), np.empty(rest, np.int64)
    begins = np.searchsorted(own[order], np.arange(groups))
    place[order] = np.arange(rest) - begins[own[order]]
    _, named = np.unique(own.astype(np.int64) * (rest + 1) + place // size, return_inverse=True)
    out[single:] = single + named
    return out


class Model:
    """words: hashes of the ids from END on, ids_of: their ids. cls: class by id; slot: place of an id among those sorted by class; first: first slot of
    each class, and the number of slots. R (ids x D), C (classes x D), Q (slots x D), b and c (biases of slots and classes), p (2 x D)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, other: int, cls: np.ndarray | None = None, seed: int = 3):
        self.words, self.ids_of = words, Listed(words, np.arange(1, len(words) + 1))
        share = np.concatenate([[other + 1.0], counts + 1.0])
        k = len(share)
        self.cls = np.arange(k, dtype=np.int32) if cls is None else cls
        by_class = np.argsort(self.cls, kind="stable")
        self.slot = np.empty(k, np.int64)
        self.slot[by_class] = np.arange(k)
        self.first = np.searchsorted(self.cls[by_class], np.arange(self.cls.max() + 2))
        mass = np.add.reduceat(share[by_class], self.first[:-1])
        self.noise, self.own = mass / mass.sum(), share[by_class] / mass[self.cls[by_class]]
        rng = np.random.default_rng(seed)
        vectors = lambda n: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
        self.R, self.Q, self.C, self.p = vectors(k), vectors(k), vectors(len(mass)), np.ones((2, DIMENSIONS), np.float32)
        self.b, self.c = np.log(self.own).astype(np.float32), np.log(self.noise).astype(np.float32)

    def start_learning(self) -> None:
        """Squared gradients of rows, and how often each row of R and Q was met."""
        self.seen = {k: np.full(len(getattr(self, k)), DAMPING, np.float32) for k in "RCQbc"}
        self.met = {"R": np.zeros(len(self.R), np.float32), "Q": np.zeros(len(self.Q), np.float32)}
        self.upto, self.ranked = np.cumsum(self.own), np.argsort(-self.noise, kind="stable")
        self.offset = np.log(RATIO * self.own).astype(np.float32)

    def learn(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> int:
        """One pass over tokens w after contexts x and y: within classes all at once, between classes in minibatches."""
        k, exact = len(self.R), min(EXACT, len(self.C))
        key, times = np.unique((w.astype(np.int64) * k + x) * k + y, return_counts=True)
        order = rng.permutation(len(key))
        key, times = key[order], times[order].astype(np.float32)
        y_, rest = key % k, key // k
        x_, w_ = rest % k, rest // k
        cls = self.cls[w_]
        pull = self._learn_within(w_, x_, y_, cls, times, rng)
        self.met["R"] += np.bincount(np.concatenate([x_, y_]), np.concatenate([times, times]), k).astype(np.float32)
        top = self.ranked[:exact]
        below = self.noise[top].sum()
        ranked = np.cumsum(self.noise[self.ranked])
        weight = RATIO * np.concatenate([self.noise[top], np.full(NOISE, (1 - below) / NOISE)]).astype(np.float32)
        offset = np.log(RATIO * self.noise).astype(np.float32)
        for at in range(0, len(key), BATCH):
            part = slice(at, at + BATCH)
            n, c = times[part], cls[part]
            rx, ry, scale = self.R[x_[part]], self.R[y_[part]], 1 / n.sum()
            hidden = rx * self.p[0] + ry * self.p[1]
            drawn = self.ranked[np.minimum(np.searchsorted(ranked, rng.random(NOISE) * (1 - below) + below, side="right"), len(ranked) - 1)]
            noise = np.concatenate([top, drawn])
            good = (hidden * self.C[c]).sum(1) + self.c[c] - offset[c]
            bad = hidden @ self.C[noise].T
            bad += self.c[noise] - offset[noise]
            g, gn = -n * _sigmoid(-good), _sigmoid(bad)
            gn *= weight
            gn *= n[:, None]
            gh = g[:, None] * self.C[c] + gn @ self.C[noise] + pull[part]
            rows = np.concatenate([c, noise])
            self._step(rows, C=np.concatenate([g[:, None] * hidden, gn.T @ hidden]) * scale, c=np.concatenate([g, gn.sum(0)]) * scale)
            self._step(np.concatenate([x_[part], y_[part]]), R=np.concatenate([gh * self.p[0], gh * self.p[1]]) * scale)
            self.p -= 0.05 * RATE * np.stack([(gh * rx).sum(0), (gh * ry).sum(0)]) * scale
        return len(w)

    def _learn_within(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, cls: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Learns Q and b, each token against OWN noise tokens that its class draws; gives the gradients of the states."""
        pull = np.zeros((len(w), DIMENSIONS), np.float32)
        many = np.flatnonzero((self.first[1:] - self.first[:-1] > 1)[cls])
        if not len(many):
            return pull
        order = many[np.argsort(cls[many], kind="stable")]
        found, begins = np.unique(cls[order], return_index=True)
        slots, hidden, rows, grads, biases = self.slot[w[order]], self.R[x[order]] * self.p[0] + self.R[y[order]] * self.p[1], [], [], []
        for c, i, j in zip(found, begins, [*begins[1:], len(order)]):
            a, z = self.first[c], self.first[c + 1]
            low, high = self.upto[a - 1] if a else 0.0, self.upto[z - 1]
            other = np.clip(np.searchsorted(self.upto, low + rng.random(OWN) * (high - low), side="right"), a, z - 1)
            h, slot, times = hidden[i:j], slots[i:j], n[order[i:j]]
            qw, qo = self.Q[slot], self.Q[other]
            good = (h * qw).sum(1) + self.b[slot] - self.offset[slot]
            bad = h @ qo.T + self.b[other] - self.offset[other]
            g, gn = -times * _sigmoid(-good), (times * (RATIO / OWN))[:, None] * _sigmoid(bad)
            pull[order[i:j]] = g[:, None] * qw + gn @ qo
            rows += [slot, other]
            grads += [g[:, None] * h, gn.T @ h]
            biases += [g, gn.sum(0)]
        rows = np.concatenate(rows)
        scale = 1 / n.sum()
        self._step(rows, Q=np.concatenate(grads) * scale, b=np.concatenate(biases) * scale)
        self.met["Q"] += np.bincount(slots, n[order], len(self.Q)).astype(np.float32)
        return pull

    def _step(self, rows: np.ndarray, **gradients: np.ndarray) -> None:
        """Adagrad by row, of the arrays named."""
        order = np.argsort(rows.astype(np.uint16) if rows.max() < 1 << 16 else rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        rows = rows[first]
        for name, g in gradients.items():
            a, seen, total = getattr(self, name), self.seen[name], np.add.reduceat(g[order], first, axis=0)
            seen[rows] += total**2 if total.ndim == 1 else (total**2).mean(1)
            pace = RATE / np.sqrt(seen[rows])
            a[rows] -= total * (pace if total.ndim == 1 else pace[:, None])

    def log_probabilities(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token w (OTHER: of the class) after x and y."""
        key = x.astype(np.int64) * len(self.R) + y
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.diff(key, prepend=-1) != 0
        state, key = np.cumsum(first) - 1, key[first]  # of the rows in order; distinct contexts
        hidden = self.R[key // len(self.R)] * self.p[0] + self.R[key % len(self.R)] * self.p[1]
        at, cls, out = np.empty(len(w), np.int64), self.cls[w], np.empty(len(w))
        at[order] = state
        bounds = np.searchsorted(state, np.arange(0, len(key) + ROWS, ROWS))
        for k in range(0, len(key), ROWS):
            rows, of = (v[bounds[k // ROWS] : bounds[k // ROWS + 1]] for v in (order, state))
            out[rows] = _log_shares(hidden[k : k + ROWS], self.C, self.c, of - k, cls[rows])
        order = np.argsort(cls.astype(np.uint16) if len(self.C) < 1 << 16 else cls, kind="stable")
        found, begins = np.unique(cls[order], return_index=True)
        for c, i, j in zip(found, begins, [*begins[1:], len(w)]):
            a, z = self.first[c], self.first[c + 1]
            for k in range(i, j if z - a > 1 else i, ROWS):
                rows = order[k : min(k + ROWS, j)]
                out[rows] += _log_shares(hidden[at[rows]], self.Q[a:z], self.b[a:z], np.arange(len(rows)), self.slot[w[rows]] - a)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """Overwrites z."""
    np.negative(np.clip(z, -60, None, out=z), out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _log_shares(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The logarithms of the shares of columns in the exponentials of their rows of h . vectors + bias.

    One product gives the scores less a bound of each row, so that none overflows; where the bound was far off, and all underflow,
    the row's greatest score is taken instead.
    """
    bound = np.sqrt((h * h).sum(1)) * np.sqrt((vectors * vectors).sum(1).max()) + bias.max()
    one = np.ones(len(bias), np.float32)
    right = np.column_stack([vectors, bias, one]).T
    score = np.column_stack([h, np.ones(len(h), np.float32), -bound]) @ right
    own = score[rows, columns]
    total = np.exp(score, out=score) @ one
    if total.min() < 1e-20:
        score = h @ vectors.T + bias
        top = score.max(1)
        own = score[rows, columns] - top[rows]
        total = np.exp(score - top[:, None]).sum(1)
    return own - np.log(total)[rows]


class Scorer:
    """Everything a partition needs: the model, counts of the TOP tokens, totals."""

    def __init__(self, model: Model, top: np.ndarray, top_counts: np.ndarray, total: int, distinct: int, listed: int):
        self.model = model
        order = np.argsort(top)
        self.top, self.top_counts, self.total, self.distinct = top[order], top_counts[order], total, distinct
        self.base = np.log10(total + distinct + 1.0)
        others = len(model.words) - 1  # without the end
        self.rest = np.log10(max(0, total - listed) + max(0, distinct - others - (total > 0)) + 1.0)

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """By text: n_tokens, known, sum of log10(c + 1) over tokens found in top, likewise for OTHER only, the model's part,
        number of OTHER tokens; then the distinct tokens not in top of each text: hash, times, text."""
        tokens, start = token_hashes(texts)
        words, at = np.unique(tokens, return_inverse=True)
        place = np.minimum(np.searchsorted(self.top, words), max(0, len(self.top) - 1))
        found = self.top[place] == words if len(self.top) else np.zeros(len(words), bool)
        count = np.where(found, self.top_counts[place], 0) if len(self.top) else np.zeros(len(words), np.int64)
        ids = self.model.ids_of(words)[at]
        score = self.model.log_probabilities(ids, *neighbours(ids, start)) / np.log(10)
        logs = np.log10(count + 1.0)[at]
        sums = [np.add.reduceat(v, start[:-1]) for v in (found[at].astype(np.int64), logs, np.where(ids == OTHER, logs, 0.0), score, (ids == OTHER).astype(np.int64))]
        rare = np.flatnonzero(~found[at])
        of, h = np.searchsorted(start, rare, side="right") - 1, tokens[rare]
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
        return np.diff(start), *sums, h[new], np.diff(np.append(new, len(h))), of[new]


def held_out(doc_id: Column) -> Column:
    """The fold that is not learned from: crc32 of the id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def profiles(train: DataFrame, words: np.ndarray, total: int) -> np.ndarray:
    """By id: the neighbours before and after among the SINGLE most frequent tokens, each a random vector, added up.

    words: hashes by id, from END on; total: tokens of train. Sums by block in the cluster; VOCABULARY x PROFILE numbers come back.
    """
    k, half = len(words) + 1, PROFILE // 2
    shared = train.sparkSession.sparkContext.broadcast(Listed(words, np.arange(1, k)))
    draw = np.random.default_rng(9).normal(0, 1, (SINGLE, half)).astype(np.float32)
    draw[OTHER] = 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, sums_ = shared.value, np.zeros((PROFILE, k))
        for b in batches:
            texts = _utf8(b.column(0))
            for i, j in _groups(texts, 4 << 20):
                tokens, start = token_hashes(texts[i:j])
                w = ids_of(tokens)
                before, _ = neighbours(w, start)
                after = np.append(w[1:], END)
                for side, near in ((0, before), (half, after)):
                    pick = np.flatnonzero((w >= SINGLE) & (near < SINGLE) & (near != OTHER))
                    own, beside = w[pick], near[pick]
                    for d in range(half):
                        sums_[side + d] += np.bincount(own, draw[beside, d], k)
        yield from _blocks("P", np.flatnonzero(np.abs(sums_).sum(0)), None, sums_.T)

    out = np.zeros((k, PROFILE), np.float32)
    for _, at, _, values in _summed(train.coalesce(max(1, -(-total // SHARD))).mapInArrow(sums, _PARTS), False):
        out[at] = values.reshape(len(at), PROFILE)
    return out


#: What partitions send of a part of the parameters: a block's rows, their weights and their values (float32).
_PARTS = "part string, block int, rows binary, weights binary, vals binary"


def _blocks(part: str, rows: np.ndarray, weights: np.ndarray | None, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """rows (sorted) of values, a batch a block of BLOCK rows."""
    for block in np.unique(rows // BLOCK):
        at = rows[rows // BLOCK == block].astype(np.int64)
        w = np.ones(len(at), np.float32) if weights is None else weights[at]
        yield pa.RecordBatch.from_pylist([{"part": part, "block": int(block), "rows": at.tobytes(), "weights": w.astype("f4").tobytes(), "vals": values[at].astype("f4").tobytes()}], schema=pa.schema([("part", pa.string()), ("block", pa.int32()), ("rows", pa.binary()), ("weights", pa.binary()), ("vals", pa.binary())]))


def _summed(parts: DataFrame, mean: bool) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Sums or weighted means of the rows of parts, block by block: first among about the square root of the partitions, then all."""

    def add(t: pa.Table) -> pa.Table:
        sums: dict[int, list] = {}
        rows = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in t.column("rows").to_pylist()]))
        total, weight = None, np.zeros(len(rows))
        for r, w, v in zip(t.column("rows").to_pylist(), t.column("weights").to_pylist(), t.column("vals").to_pylist()):
            at, w = np.searchsorted(rows, np.frombuffer(r, np.int64)), np.frombuffer(w, "f4").astype(np.float64)
            v = np.frombuffer(v, "f4").reshape(len(at), -1)
            total = np.zeros((len(rows), v.shape[1])) if total is None else total
            total[at] += v * w[:, None] if mean else v
            weight[at] += w
        if mean:
            total /= weight[:, None]
        return pa.table({"part": [t.column("part")[0].as_py()], "block": pa.array([t.column("block")[0].as_py()], pa.int32()), "rows": pa.array([rows.tobytes()], pa.binary()), "weights": pa.array([weight.astype("f4").tobytes()], pa.binary()), "vals": pa.array([total.astype("f4").tobytes()], pa.binary())})

    salts = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    some = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("part", "block", "salt").applyInArrow(lambda t: add(t), _PARTS)
    for r in some.groupBy("part", "block").applyInArrow(lambda t: add(t), _PARTS).toLocalIterator():  # a row a block of the model
        yield r["part"], np.frombuffer(r["rows"], np.int64), np.frombuffer(r["weights"], "f4"), np.frombuffer(r["vals"], "f4")


def fit(docs: DataFrame, counts: DataFrame, held: Column) -> tuple[Model, DataFrame, int, int, int]:
    """The model of all documents not held out; counts: token_counts() of them, kept."""
    spark = docs.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = int(END_HASH.astype(np.int64))
    listed = counts.where((F.col("h") != end) & (F.col("c") >= LEAST) & (_step("c") >= frequent(counts, VOCABULARY))).toArrow()  # VOCABULARY rows of 16 bytes
    h, c = listed.column("h").to_numpy(), listed.column("c").to_numpy()
    order = np.lexsort((h, -c))
    ends = counts.where(F.col("h") == end).select("c").collect()
    words = np.concatenate([[end], h[order]]).astype(np.int64).view(np.uint64)
    c = np.concatenate([[ends[0][0] if ends else 0], c[order]]).astype(np.float64)
    held_in = int(c.sum())
    train = docs.where(~held).select("text")
    small_batches(spark)
    model = Model(words, c, total - held_in, classes_of(np.concatenate([[total - held_in], c]), profiles(train, words, total)))
    model.start_learning()
    rng = np.random.default_rng(5)
    n = train.count()
    deal = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, WARM_UP / max(1, n)))
    texts = sorted((r["text"] or "").encode() for r in train.where(deal & (F.length("text") <= WARM_CHARS)).distinct().limit(2 * WARM_UP).collect())
    for _ in range(2):
        for i, j in _groups(texts, 1 << 20):
            tokens, start = token_hashes(texts[i:j])
            ids = model.ids_of(tokens)
            model.learn(ids, *neighbours(ids, start), rng)
    # partitions that learn: of SHARD tokens or so, so that what they send is less than the input, however small its partitions are
    shards = train.coalesce(max(1, -(-int(total) // SHARD)))
    shared = spark.sparkContext.broadcast(model)  # VOCABULARY x (2 D + 3) numbers at most, and their squared gradients

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n, r = copy.deepcopy(shared.value), 0, np.random.default_rng(7)
        m.met = {k: np.zeros_like(v) for k, v in m.met.items()}
        for b in batches:
            texts = _utf8(b.column(0))
            for i, j in _groups(texts, 1 << 20):
                tokens, start = token_hashes(texts[i:j])
                ids = m.ids_of(tokens)
                n += m.learn(ids, *neighbours(ids, start), r)
        if n:
            yield from _blocks("R", np.flatnonzero(m.met["R"]), m.met["R"], m.R)
            yield from _blocks("Q", np.flatnonzero(m.met["Q"]), m.met["Q"], np.column_stack([m.Q, m.b]))
            yield from _blocks("C", np.arange(len(m.C)), np.full(len(m.C), n, np.float32), np.column_stack([m.C, m.c]))
            yield from _blocks("p", np.arange(2), np.full(2, n, np.float32), m.p)

    for part, at, _, values in _summed(shards.mapInArrow(run, _PARTS), True):
        values = values.reshape(len(at), -1)
        getattr(model, part)[at] = values[:, :DIMENSIONS]
        if part in "QC":
            {"Q": model.b, "C": model.c}[part][at] = values[:, DIMENSIONS]
    for name in ("seen", "met", "upto", "ranked", "offset"):
        delattr(model, name)
    return model, train, total, distinct, held_in


def _step(c: str) -> Column:
    """A sixteenth of an octave of a count."""
    return F.floor(F.log2(F.col(c)) * 16)


def frequent(counts: DataFrame, most: int) -> int:
    """The least step of counts that at most so many tokens reach: from a table of steps, so that no task and not the
    driver sees more tokens than are asked for."""
    rows, n, least = counts.groupBy(_step("c").alias("step")).count().orderBy(F.desc("step")).collect(), 0, 1 << 30  # 64 x 16 rows at most
    for r in rows:
        n += r["count"]
        if n > most:
            break
        least = r["step"]
    return least


def score(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (the model), log10."""
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    docs = docs.select("doc_id", "text")
    counts = cut(token_counts(docs.where(~held)))
    model, _, total, distinct, listed = fit(docs, counts, held)
    top = counts.where((_step("c") >= frequent(counts, TOP)) | (F.col("h") == int(END_HASH.astype(np.int64)))).select("h", "c").toArrow()  # about TOP rows of 16 bytes at most
    scorer = Scorer(model, top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), total, distinct, listed)
    shared = spark.sparkContext.broadcast(scorer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            texts = _utf8(b.column(1))
            for i, j in _groups(texts, 4 << 20):
                n, known, logs, other_logs, part, others, rare, times, of = s.batch(texts[i:j])
                cut_ = np.searchsorted(of, np.arange(j - i + 1))
                pairs = pa.StructArray.from_arrays([pa.array(rare.view(np.int64)), pa.array(times, pa.int64())], ["h", "times"])
                lists = pa.ListArray.from_arrays(pa.array(cut_, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *map(pa.array, (n, known, logs, other_logs, part, others)), lists], ["doc_id", "held_out", "n_tokens", "known", "logs", "other_logs", "part", "others", "rare"])

    seen = docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, other_logs double, part double, others long, rare array<struct<h:long,times:long>>")
    seen = cut(seen).withColumn("row", F.monotonically_increasing_id())  # of kept partitions: the same each time
    tokens = seen.select("row", F.inline("rare"))
    rare = tokens.join(counts, "h").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    df = seen.drop("rare").join(rare, "row", "left").na.fill(0, ["rare_known"]).na.fill(0.0, ["rare_logs"])
    return df.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * float(scorer.base)).alias("base_score"),
        (F.col("part") + F.col("other_logs") + F.col("rare_logs") - F.col("others") * float(scorer.rest)).alias("score"),
    )
