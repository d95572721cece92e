"""Folders and tables that operators write on their way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; a temporary one where that is unset in local
    mode, as in tests."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, top, True)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in such a folder: for rows that are dear to make and used more than once."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
