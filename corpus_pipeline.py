"""The corpus pipeline: from documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
columns text, lang and n_chars follow a stage's decisions. Columns beside those of documents are left out, whatever they are called.
An empty table gives an empty result of the same columns at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, line_dedup, minhash, packing, pii
from lodestone.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language prediction with a lower score than this, or none, rejects the document.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts the language of every document, takes it as lang, and rejects documents without a clear one.

    Null texts and texts without a letter have none, and go; with no labelled document to learn from, all do. A null lang is not learned
    from, but predicted; of languages equally near, the first by name is taken; repeated rows are decided on alike.
    """
    model = language.train(docs, language.held_out(F.col("doc_id")))
    found = language.identify(docs, model, keep=("text", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that stand in ten documents or more (rows that share a doc_id are one, null being an id).

    Null and empty texts become an empty text; a document that loses all its lines stays, with an empty text. Empty lines stay.
    """
    marked = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs), ("lang", "source"))
    kept = marked.withColumn("text", line_dedup.kept_text(F.col("text"), F.col("keep")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates; of rows that repeat id and text, one.

    Texts without a word are near nothing and stay, one row of each id. A null id is the smallest. Ties of an id go to the smaller hash of a text.
    """
    found = minhash.near_duplicates(docs, width=5, percent=80).where("leader")
    kept = found.select(F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_n"), F.col("text_hash").alias("_t")).distinct()
    keys = {"_i": F.coalesce("doc_id", F.lit(0)), "_n": F.col("doc_id").isNull(), "_t": F.xxhash64("text")}
    return docs.select(*COLUMNS).withColumns(keys).join(kept, [*keys], "left_semi").dropDuplicates([*keys]).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format. Null texts stay null, and n_chars is then null; repeated rows get equal texts."""
    return pii.pseudonymize(docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into windows of 2048, mixed by source; a row a piece, with its token ids.

    A null text is an end token alone; a null source is a queue of its own; repeated rows are documents each.
    """
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), ranks=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("near_dedup", near_dedup),
    ("pii", pseudonyms),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept in the shared checkpoint folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs


#: Language prediction, token ids and keyed permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
