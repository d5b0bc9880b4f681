"""Session settings and durable intermediate tables for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from verisieve.sources.tables import shared_folder


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def tune(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the Arrow batches that Python workers hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until ``df`` has no such column."""
    held = {c.lower() for c in df.columns}
    while wanted.lower() in held:
        wanted = "_" + wanted
    return wanted


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than the rows it was
    working on. ``df.stashed_at`` of the result is the path.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stashed_at = path
    if _scopes:
        _scopes[-1].append(back)
    return back


_scopes: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Collects the tables that are stashed meanwhile, for ``forget`` once nothing reads them."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def forget(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more."""
    path = getattr(df, "stashed_at", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
