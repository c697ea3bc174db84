"""Folders for what a query writes on its way: under the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir; where that is unset, under a
    temporary folder of a local master (removed at exit), else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.verity.scratch", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="verity-scratch-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.verity.scratch", root)
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows from a table in a scratch folder: made once, and there after a lost executor."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
