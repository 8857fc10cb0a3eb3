"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in a process of its own (local tests).

    On a cluster without that setting it's an error: a folder of the driver's would not reach the executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidewheel-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def settled(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder: what is made of it neither computes it again nor holds its plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
