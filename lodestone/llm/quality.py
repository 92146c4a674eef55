"""Quality rules with risk-controlled thresholds.

A document has shares in thousandths (symbols, capitals, exclamation marks, repeated lines, repeated words); a rule rejects it when a
share lies above the rule's cutoff. How strict the cutoffs are is not set by hand: PATH is a sequence of settings, each of a cutoff for
every rule, from the loosest to the strictest, and every stratum (band of word counts) goes down it as far as its labels allow.

Labelled documents are the holdout. Copies are no independent trials: labelled good documents of a stratum whose smallest hash of a five-word shingle is the same
are one trial (exact copies always, near copies of similarity s in a share s of cases), which a setting rejects if it rejects any of them. A document
with labels of both qualities is no good one. A setting is certified if at most k of the stratum's n trials are beyond any of its
cutoffs, and the exact binomial tail P(X <= k | n, RISK) is within the stratum's error. Settings are tested in order and the first
that fails ends it: a fixed sequence needs no correction along it. Over strata the error 1 - CONFIDENCE is divided (Bonferroni); a
stratum that reaches the end of PATH passes its share on to those that did not, in equal parts (a graphical procedure, as strong as Holm's),
until none gets further. So with confidence CONFIDENCE, all rules together falsely reject less than RISK of the good texts of every
stratum, copies counted once. A stratum with too few trials to show that (at the defaults under 217) gets no setting: no rule rejects its documents.

DataFrame operations only on documents and labels; labelled documents are found before their texts are looked at. The driver
computes binomial tails for a table of strata x settings (some fifty numbers, whatever the input's size).

Rows: null and empty texts have no words, all counts 0, and fail the base rules; repeated rows get a result each;
labels without a document, or with a null quality, are left out, labels that repeat an id count once, rows that repeat an id are rows each, and an empty table of labels
certifies nothing; other columns are left out, whatever they are called; an empty table of documents gives an empty result.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Up to this many ids of labelled documents are broadcast.
BROADCAST_IDS = 500_000
#: Of all rules together, in every stratum.
RISK, CONFIDENCE = 0.02, 0.95
#: The first word count of each stratum, and cutoffs in thousandths by rule and setting, loosest first.
STRATA = (0, 64, 256, 1024)
PATH = {
    "symbols": (600, 500, 400, 300, 250, 200, 150, 100, 80, 60, 40, 30),
    "capitals": (900, 850, 800, 750, 700, 650, 600, 550, 500, 450, 400, 350),
    "shouts": (300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20),
    "same_lines": (950, 900, 850, 800, 750, 700, 650, 600, 550, 500, 450, 400),
    "same_words": (980, 960, 940, 920, 900, 870, 840, 800, 750, 700, 650, 600),
}
RULES, SETTINGS = tuple(PATH), 12
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", "#*$%&|<>"
WINDOW, SHINGLE = 8, 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern + "+", ""))


def _number(text: Column, chars: str) -> Column:
    """How often any of a few characters occurs."""
    return functools.reduce(lambda a, b: a + b, (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars))


def _permille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("int")


def light_counts(docs: DataFrame) -> DataFrame:
    """doc_id, words, the counts that need one look at the text, and the shares of RULES."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    text = F.col("text")
    df = df.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _number(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.length(text) - _without(text, r"[\p{Lu}]")).alias("n_capitals"),
        _number(text, "!").alias("n_shouts"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    band = F.lit(0)
    for i, least in enumerate(STRATA):
        band = F.when(F.col("n_words") >= least, i).otherwise(band)
    return df.withColumns(
        {
            "stratum": band,
            "symbols": _permille(F.col("n_symbols"), F.col("word_chars")),
            "capitals": _permille(F.col("n_capitals"), F.col("word_chars")),
            "shouts": _permille(F.col("n_shouts"), F.col("word_chars")),
            "same_lines": _permille(F.col("n_dup_lines"), F.col("n_lines")),
            "same_words": _permille(F.col("n_words") - F.col("n_distinct"), F.col("n_words")),
        }
    )


def repeated_words(df: DataFrame, words: str = "words", out: str = "n_repeat_words") -> DataFrame:
    """Adds the number of words that stand in a window of WINDOW words found twice or more in the document."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    df = df.withColumn("_h", F.when(n > WINDOW, hashes))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: ((k > 0) & (F.get("_s", k - 1)["h"] == x["h"])) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial."""
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    most = max(log, default=-math.inf)
    return min(1.0, math.exp(most) * sum(math.exp(x - most) for x in log)) if log else 0.0


def certified(n: int, k: int, risk: float, error: float) -> bool:
    """Whether k false rejections among n show a rate below risk, at that error. Past n * risk they never do."""
    return n > 0 and k < n * risk and binomial_tail(k, n, risk) <= error


def descend(n: dict[int, int], beyond: dict[int, list[int]], risk: float = RISK, confidence: float = CONFIDENCE) -> dict[int, int]:
    """stratum -> the strictest certified setting; strata without one are left out. n: good documents, beyond: of them, those
    that each setting rejects, by stratum."""
    error = {s: (1 - confidence) / len(STRATA) for s in range(len(STRATA))}
    at = dict.fromkeys(n, -1)
    while True:
        for s in n:
            while at[s] + 1 < len(beyond[s]) and certified(n[s], beyond[s][at[s] + 1], risk, error[s]):
                at[s] += 1
        ended = [s for s in n if error[s] and at[s] + 1 == len(beyond[s])]
        left = [s for s in n if at[s] + 1 < len(beyond[s])]
        if not ended or not left:
            return {s: k for s, k in at.items() if k >= 0}
        for s in left:
            error[s] += sum(error[e] for e in ended) / len(left)
        error.update(dict.fromkeys(ended, 0.0))


def trial_key(words: Column) -> Column:
    """The smallest hash of a SHINGLE-word shingle; of fewer words, that of all."""
    n = F.size(words)
    return F.when(n <= SHINGLE, F.xxhash64(words)).otherwise(F.array_min(F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))))


def trials(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, n, and s0, s1, ... (trials that each setting rejects). labels: doc_id and quality, 1 for good."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)  # else the texts of labelled documents are shuffled once
    held = light_counts(docs.select("doc_id", "text").join(good, "doc_id", "left_semi"))
    rejected = lambda k: functools.reduce(lambda a, b: a | b, (F.col(r) > PATH[r][k] for r in RULES))
    each = held.groupBy("stratum", trial_key(F.col("words")).alias("key")).agg(*(F.bool_or(rejected(k)).alias(f"s{k}") for k in range(SETTINGS)))
    return each.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(f"s{k}").alias(f"s{k}") for k in range(SETTINGS)))


def calibrate(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> dict[int, int]:
    """stratum -> setting."""
    table = trials(docs, labels).collect()  # a row a stratum
    return descend({r["stratum"]: r["n"] for r in table}, {r["stratum"]: [r[f"s{k}"] for k in range(SETTINGS)] for r in table}, risk, confidence)


def quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the base counts, base_failed, failed_rules (array of names) and kept."""
    settings = calibrate(docs, labels, risk, confidence)
    df = repeated_words(light_counts(docs))
    broken = F.array_compact(F.array(*(F.when((F.col("stratum") == s) & (F.col(r) > PATH[r][k]), F.lit(r)) for s, k in sorted(settings.items()) for r in RULES), F.lit(None).cast("string")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumns({"failed_rules": broken, "base_failed": failed})
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
