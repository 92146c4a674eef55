"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as its part boundaries with, beside them, the rank of merging each part with the next. The array is
scanned for the smallest rank (the leftmost on ties), that boundary is deleted and the ranks of the two
neighbours are read again, until no rank is left. Words over LONG_WORD symbols take a heap over the same ranks, which
gives the same merges without the quadratic scan.

Encoding follows the vocabulary file: added tokens are cut out first, then NFC, lower case and the pre-token pattern,
none of which looks across white space. So a text is encoded chunk by chunk (runs without white space), and chunks
are remembered in a bounded table.

Rows: null text counts as empty and gives no ids; repeated rows and ids give a row each; columns besides the id and
text columns are left out, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex as LibraryRegex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from lodestone.llm.common import small_batches

LONG_WORD = 200
#: Chunks and words that a worker remembers, each: a bound of memory, not of what is encoded.
REMEMBERED = 300_000
#: White space of the vocabulary's patterns (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
_SPACES = re.compile(f"[{SPACE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to str.split(), but not here
NONE = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 upwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder(dict):
    """Chunk -> (its ids as text, its token strings), each joined by one space; chunks not met before are encoded."""

    def __init__(self, path: str):
        super().__init__()
        conf = json.load(open(path, encoding="utf-8"))
        model = conf["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.strings = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), rank)
            self.made.append(self.vocab[a + b])
        self.words = regex.compile(conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, Split(LibraryRegex(self.words.pattern), "removed", invert=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.letters = byte_alphabet()
        self.known: dict[str, list[int]] = {}

    # one word

    def merge(self, ids: list[int]) -> list[int]:
        """ids after all merges."""
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get, made = self.ranks.get, self.made
        near = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while near:
            best = min(near)
            if best == NONE:
                break
            i = near.index(best)
            ids[i] = made[best]
            del ids[i + 1], near[i]
            if i < len(near):
                near[i] = get((ids[i], ids[i + 1]), NONE)
            if i:
                near[i - 1] = get((ids[i - 1], ids[i]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, alive = self.ranks.get, [True] * len(ids)
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (rank := get((ids[i], ids[i + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (rank := get((ids[k], ids[after[k]]), NONE)) != NONE:
                    heapq.heappush(heap, (rank, k, ids[k], ids[after[k]]))
        return [x for x, here in zip(ids, alive) if here]

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if (ids := self.known.get(word)) is None:
            symbols = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            ids = self.merge([self.vocab[s] for s in symbols if s in self.vocab])
            if len(self.known) < REMEMBERED:
                self.known[word] = ids
        return ids

    def split(self, part: str) -> list[str]:
        """Pre-tokens of a chunk, normalised. Beyond Latin letters the library's own Unicode tables decide."""
        if part.isascii():
            return self.words.findall(part.lower())
        if max(part) < "\u0300":
            return self.words.findall(unicodedata.normalize("NFC", part).lower())
        return [x for x, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]

    # chunks and texts

    def __missing__(self, chunk: str) -> tuple[str, str]:
        ids = []
        for part in self.cut.split(chunk):
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for word in self.split(part):
                    ids += self.word(word)
        out = (" ".join(map(str, ids)), self.decode(ids))
        if len(self) < REMEMBERED:  # frequent chunks come early
            self[chunk] = out
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the vocabulary file, token strings are joined by spaces."""
        return " ".join(map(self.strings.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        return text.split() if not _ODD_SPACE.search(text) else [x for x in _SPACES.split(text) if x]

    def both(self, text: str) -> tuple[str, str]:
        """Ids as decimal text, and the decoded text."""
        got = [x for x in map(self.__getitem__, self.chunks(text)) if x[0]]
        return " ".join([x[0] for x in got]), " ".join([x[1] for x in got])

    def encode(self, text: str) -> list[int]:
        ids = self.both(text)[0]
        return list(map(int, ids.split(" "))) if ids else []


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, decoded string of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            both = [enc.both(t or "") for t in b.column(1).to_pylist()]
            ids = [list(map(int, x.split(" "))) if x else [] for x, _ in both]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([x for _, x in both], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode_documents() without carrying ids and texts out of the worker."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = encoder(vocabulary), hashlib.sha256
        for b in batches:
            n, x, y = [], [], []
            for t in b.column(1):
                ids, decoded = enc.both(t.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                x.append(sha(ids.encode()).hexdigest())
                y.append(sha(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
