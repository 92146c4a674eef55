"""Cutting the lineage of iterative jobs, in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: spark.checkpoint.dir. Where that is unset, a temporary folder, but only for a local
    master: on a cluster, executors do not see a folder of the driver.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder. It keeps its partitioning, and the optimiser's estimate of its size."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back, for loops that join a frame with what came of it.

    Its size is that of its files: the estimate of a checkpointed frame is the product of what was joined, and would be squared
    in every round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
