"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier a bit, a logistic regression on byte 2-grams and 3-grams
of the lower-cased letters, predicts that bit of the codeword; classifiers need not agree on a language one by one,
as the distance between codewords corrects those that err. Decoding weighs each bit by how well its classifier did
in training and takes the codeword of the least weighted loss; the score is that codeword's share of the likelihood, and
a document whose runner-up is nearly as close is flagged as ambiguous.

Up to six languages get all distinct splits of the languages as bits (the exhaustive code); more get random bits, the
best of a number of draws by the smallest distance between two codewords.

The classifiers are fitted on a sample of the documents of every language, dealt by a hash of the id and the text, about
SAMPLE of each or, with more than ROWS / SAMPLE languages, ROWS in all; every document is predicted from its whole text.

Rows: null text, and text without a letter, are 'und' with score 0; rows without a language are not learned from;
with no row to learn from, all documents are 'und'; repeated rows get a result each; other columns are left out,
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches

#: Documents of each language that the classifiers are fitted on, about; with many languages fewer of each, about ROWS
#: in all, but never under LEAST of each. All languages are learned.
SAMPLE, ROWS, LEAST = 500, 32_000, 50
PAIRS, TRIPLES = 1024, 4096
FEATURES = PAIRS + TRIPLES
#: A runner-up whose share of the likelihood is over this makes a prediction ambiguous.
AMBIGUOUS = 0.35
#: What features are held in while a model is learned; sums are of single precision.
HELD = np.float16
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are no letter count as a space; all bytes of characters outside ASCII stay.
_PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.int32)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 2-grams and 3-grams."""
    b = _PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    pairs = (b[:-1] * 256 + b[1:]) * 40503 >> 6 & PAIRS - 1
    triples = ((b[:-2] * 256 + b[1:-1]) * 31 + b[2:]) * 40503 >> 7 & TRIPLES - 1
    out = np.empty(FEATURES, np.float32)
    out[:PAIRS] = np.bincount(pairs, minlength=PAIRS) / max(1, len(pairs))
    out[PAIRS:] = np.bincount(triples, minlength=TRIPLES) / max(1, len(triples))
    return np.sqrt(out)


def codewords(k: int, seed: int = 1) -> np.ndarray:
    """k codewords of -1 and 1, a row a language."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        return np.array([[1, *x] for x in itertools.product((1, -1), repeat=k - 1) if -1 in x], float).T
    bits, draw, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None
    for _ in range(200):
        code = draw.choice((-1.0, 1.0), (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * bits
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


class Model:
    """languages, codewords (languages x bits), weights (features x bits), bias and trust (by bit)."""

    def __init__(self, languages, code, weights, bias, trust):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each codeword, a row a document."""
        margin = (x @ self.weights + self.bias).astype(np.float64)
        # log(1 + exp(-m)) is log(1 + exp(m)) - m: all codewords in one product
        return (self.trust * np.logaddexp(0, margin)).sum(1, keepdims=True) - (self.trust * margin) @ (self.code.T > 0)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, share of the runner-up."""
        loss = self.losses(x)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, p.max(1)


def fit(texts: list[str], langs: list[str], **how) -> Model | None:
    """fit_rows() of texts and their languages."""
    known = [(x, t) for t, x in zip(texts, langs) if t and _LETTER.search(t)]
    return fit_rows([x for x, _ in known], [features(t).astype(HELD) for _, t in known], **how)


def fit_rows(langs: list[str], rows: list[np.ndarray], steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Model | None:
    """Binary classifiers for all bits at once, by Adam on the logistic loss over all rows (features, in the precision HELD)."""
    names = sorted(set(langs))
    if not names:
        return None
    code, size = codewords(len(names)), 2048
    blocks = [np.stack(rows[k : k + size]) for k in range(0, len(rows), size)]
    at = np.searchsorted(names, langs)
    share = (len(at) / len(names) / np.bincount(at)[at])[:, None].astype(np.float32)  # languages weigh the same
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k, x in enumerate(blocks):
            own = slice(k * size, k * size + len(x))
            yield x.astype(np.float32), code[at[own]].astype(np.float32), share[own]

    for t in range(1, steps + 1):
        g, gb = decay * w, np.zeros_like(b)
        for x, y, part in parts():
            pull = -y * part / (1 + np.exp(np.clip(y * (x @ w + b), -60, 60)))
            g += x.T @ pull / len(at)
            gb += pull.sum(0) / len(at)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    right = sum(((x @ w + b) * y > 0).sum(0) for x, y, _ in parts()) / len(at)
    trust = np.log(np.maximum(right, 0.51) / np.maximum(1 - right, 1e-3))
    return Model(names, code, w, b, trust / trust.mean())


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, x: the features of texts with a letter, as bytes of one length, however long the texts."""
    for batch in batches:
        found = [(x.as_py(), features(t.as_py()).astype(HELD).tobytes()) for x, t in zip(batch.column(0), batch.column(1)) if t.as_py() and _LETTER.search(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([f for _, f in found], pa.binary())], ["lang", "x"])


def train(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of the rows of docs that have a language and are not held out. Features are made where the texts are: the driver gathers
    FEATURES numbers of HELD a row of the sample."""
    small_batches(docs.sparkSession)
    known = docs.where(~held_out & F.col("lang").isNotNull()).select("text", "lang", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("_deal"))
    counts = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())  # a row a language
    if not counts:
        return None
    sample = min(sample, max(LEAST, ROWS // len(counts)))
    below = pa.table({"lang": [x for x, _ in counts], "_below": [int((1 << 30) * min(1.0, sample / n)) for _, n in counts]})
    chosen = known.join(F.broadcast(docs.sparkSession.createDataFrame(below)), "lang").where(F.col("_deal") < F.col("_below"))
    # copies of a text are dealt alike: one stands for all, so that they take no other language's place
    rows = sorted((r["lang"], bytes(r["x"])) for r in chosen.select(F.col("lang").cast("string").alias("lang"), "text").distinct().mapInArrow(_as_rows, "lang string, x binary").toLocalIterator())
    return fit_rows([x for x, _ in rows], [np.frombuffer(x, HELD) for _, x in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score and ambiguous of every text, and the columns named in keep."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if m and t and _LETTER.search(t)]
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for k in range(0, len(at), 256):
                rows = at[k : k + 256]
                best, top, second = m.predict(np.stack([features(texts[i]) for i in rows]))
                for i, j in zip(rows, best):
                    lang[i] = m.languages[j]
                score[rows], unsure[rows] = top, second > AMBIGUOUS
            kept = [b.column(2 + i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([b.column(0), *kept, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [id_col, *keep, "lang_pred", "score", "ambiguous"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", lang_pred string, score double, ambiguous boolean"
    return docs.select(id_col, text_col, *keep).mapInArrow(run, out)


def held_out(doc_id: Column) -> Column:
    """The fold that is not learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
