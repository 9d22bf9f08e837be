"""Cutting the lineage of intermediates that several plans read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a temporary folder is set
    if the master is local; on a cluster no folder of one machine would do, so that is
    an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores if the scan is fewer tasks than there are cores, as of a small
    file: for work on texts that takes much longer than moving them.  Larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
