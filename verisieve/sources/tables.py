"""Parquet table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``; a path of any scheme that Spark reads."""
    return spark.read.parquet(f"{root}/{name}.parquet")


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where it is unset, a
    temporary one of this process, which only a local session may use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="verisieve-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: what follows neither evaluates
    its plan again nor loses more than a task with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
