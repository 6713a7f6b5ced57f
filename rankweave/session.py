"""Settings that a running session needs for the engine."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Batches between the JVM and Python: whole texts are long, and both sides hold several batches at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it, and bounds Arrow batches
    where the session has left them at Spark's defaults.

    A cluster whose machines do not share that folder gets the package by ``--py-files`` instead.
    """
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, ours)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the folder of ``spark.checkpoint.dir``, which all machines share.

    Only where the setting is missing and all runs in one process, as in tests, a temporary folder serves.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankweave-checkpoint-"))
    return df.checkpoint(eager=True)
