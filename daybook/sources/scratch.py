"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on one machine and an
    error on a cluster."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="daybook-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        known = "file://" + folder
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now and stored where lost executors do not matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
