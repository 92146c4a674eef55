"""Shared helpers of the corpus operators: batches, partition counts, expressions. Checkpoints are those of all operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut, settled

__all__ = ["ASCII_SPACE", "ascii_lower", "cut", "documents", "let", "partitions", "reclaim", "settled", "small_batches"]

#: ASCII white space, as the operators' contracts name it.
ASCII_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 500 rows and about 4 MB: a worker holds one batch at a time, however long the texts.

    The same for all operators, as lazy plans of a session share its settings.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def reclaim(spark: SparkSession) -> None:
    """Frees the shuffle files of frames that nothing refers to any more: left alone, the cleaner waits until the driver's memory, not
    the executors' disk, runs short.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body of a value that is computed once: a column named several times, or inside a lambda, is computed each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only.

    lower() is quick and right unless the text has a character outside ASCII that has a lower case; such texts
    go through translate().
    """
    other = c.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^\x00-\x7F]]")
    return F.when(other, F.translate(c, _UPPER, _LOWER)).otherwise(F.lower(c))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
