"""Tables dealt by key into a fixed number of files, so that joins and groupings by that key move nothing.

A bucketed table is an ordinary Parquet folder with as many sets of files as buckets; what Spark
must know besides (keys and number) is given again when the folder is opened by another session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` by buckets of ``keys``, sorted by them in each, and open it. A
    bucket is one file, whose size is for the caller to choose by ``buckets``."""
    name = f"verisieve_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A folder that ``write_bucketed`` wrote with the same keys and number."""
    name = f"verisieve_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{k}`" for k in keys)
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)
