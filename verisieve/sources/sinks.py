"""Writers: idempotent, resumable and staged tables, text formats, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.operators import relational as rel
from verisieve.sources.readers import exists
from verisieve.sources.tables import shared_folder, written


def write_json(df: DataFrame, path: str, mode: str = "overwrite", order: list[str] | None = None) -> None:
    """JSON lines; with ``order`` they rise from line to line and from file to file, in the order of
    the files' names, and each task sorts its own range."""
    (df if order is None else df.repartitionByRange(*order).sortWithinPartitions(*order)).write.mode(mode).json(path)


def cell(x: Column, places: int = 4, empty: str = "—") -> Column:
    """Fixed places; ``empty`` for null and NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.format_string(f"%.{places}f", x.cast("double"))).otherwise(empty)


def write_csv(df: DataFrame, path: str, columns: list[str], places: int | None = None, mode: str = "overwrite") -> None:
    """The named columns; other columns are left out, absent ones are empty, floats may get fixed places."""
    kinds = dict(df.dtypes)
    out = [F.lit(None).cast("string").alias(c) if c not in kinds else (cell(F.col(c), places, "").alias(c) if places is not None and kinds[c] in ("double", "float") else F.col(c)) for c in columns]
    df.select(*out).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_layers(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors or tensors by (model, dataset, layer): one directory each, so a reader prunes. Large
    layers are written by several tasks, small ones together."""
    df.hint("rebalance", "model", "dataset", "layer").write.mode(mode).partitionBy("model", "dataset", "layer").parquet(path)


def write_split(ids: DataFrame, path: str) -> None:
    """The ids of column ``id``, in order, as one JSON array; a split's ids are one file by definition."""
    ids.groupBy().agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_bundle(df: DataFrame, path: str, key: list[str], layer: str = "layer", mode: str = "overwrite") -> None:
    """A table of tensors (any nesting of arrays, labels beside them) by layer, sorted by key in each
    file, so that readers skip row groups. Large layers are written by several tasks."""
    df.hint("rebalance", layer).sortWithinPartitions(layer, *key).write.mode(mode).partitionBy(layer).parquet(path)


def write_model(model: DataFrame, path: str, config: dict[str, str] | None = None, metrics: DataFrame | None = None, mode: str = "overwrite") -> None:
    """A coefficient table with its configuration, and beside it the metrics of its evaluation."""
    model.withColumn("config", F.create_map(*[F.lit(v) for kv in (config or {"": ""}).items() for v in kv])).write.mode(mode).parquet(f"{path}/model")
    if metrics is not None:
        metrics.write.mode(mode).json(f"{path}/metrics")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/model")


def copy_small(df: DataFrame, path: str, wanted: int, sample: callable) -> DataFrame:
    """A table of at most ``wanted`` rows as it is, a larger one through ``sample``; written and read back."""
    small = df.limit(wanted + 1).count() <= wanted
    (df if small else sample(df)).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def materialise(spark: SparkSession, path: str, build: callable, overwrite: bool = False) -> DataFrame:
    """The table at ``path``; built only where it is not complete or ``overwrite`` is set."""
    if overwrite or not complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(source: DataFrame, path: str, key: list[str], process: callable, batch_rows: int = 100_000) -> DataFrame:
    """Process the rows whose keys the table at ``path`` lacks, and append the results batch by batch.

    The rows to do are written first, then dealt by hash of their keys into batches of about
    ``batch_rows``, a folder each, so that a batch reads its own rows and no others; it is appended
    before the next one is begun. A run that is killed loses one batch at most: the next run does
    what is not in the table yet."""
    spark = source.sparkSession
    todo = rel.pending(source, spark.read.parquet(path), key) if exists(spark, path) else source
    todo = written(todo)
    n = todo.count()
    batches = max(1, -(-n // batch_rows))
    if n or not exists(spark, path):
        dealt = None if batches == 1 else _dealt(todo, key, batches)
        for i in range(batches):
            if dealt is None:
                mine = todo
            elif exists(spark, f"{dealt}={i}"):
                mine = spark.read.schema(todo.schema).parquet(f"{dealt}={i}")
            else:  # no key fell to it
                continue
            process(mine).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _dealt(rows: DataFrame, key: list[str], batches: int) -> str:
    """Writes the rows by batch of their keys; batch i is in the folder ``{the result}={i}``."""
    name = "_batch"
    while name in rows.columns:
        name = f"_{name}"
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    at = rows.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(batches)).cast("int"))
    at.repartition(name).write.partitionBy(name).parquet(path)
    return f"{path}/{name}"


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the manifests, oldest first."""
    fs, where = _files(spark, f"{path}/_manifests")
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def _target(spark: SparkSession, path: str, manifest: str) -> str | None:
    """The folder that a manifest names; None while it is not whole (a line that ends)."""
    fs, where = _files(spark, f"{path}/_manifests/{manifest}")
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text[:-1] if text.endswith("\n") else None


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the table that was last promoted to ``path``."""
    for manifest in reversed(_versions(spark, path)):
        target = _target(spark, path, manifest)
        if target:
            return f"{path}/{target}"
    return None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table that was last promoted; it stays as it is while others are promoted."""
    found = current(spark, path)
    if found is None:
        raise ValueError(f"no table was promoted to {path}")
    return spark.read.parquet(found)


def promote(df: DataFrame, path: str, expected: DataFrame, key: list[str]) -> str | None:
    """Write a new version below ``path``, check that every expected key is there, then name it in a
    new manifest, which is what ``read_current`` goes by.

    Nothing is renamed or replaced: a reader sees the old table until the manifest is whole, then
    the new one, on object stores too. Manifests are numbered; of two writers that promote at once
    the one that comes second to a number gets an error. Returns the folder of the former table,
    None if there was none; an incomplete table is an error and leaves the former one current."""
    spark = df.sparkSession
    had, names = current(spark, path), _versions(spark, path)
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    lacking = expected.select(*key).join(spark.read.parquet(f"{path}/{version}").select(*key), key, "left_anti").count()
    if lacking:
        raise ValueError(f"{lacking} expected keys are missing; the table stays in {path}/{version}")
    number = int(names[-1]) + 1 if names else 0
    fs, where = _files(spark, f"{path}/_manifests/{number:012d}")
    out = fs.create(where, False)
    try:
        out.write(bytearray(f"{version}\n".encode()))
    finally:
        out.close()
    return had


def markdown(df: DataFrame, title: str, columns: list[str], places: int = 4, most: int = 1000) -> str:
    """A table of at most ``most`` rows as Markdown text."""
    kinds = dict(df.dtypes)
    shown = df.select(*[cell(F.col(c), places).alias(c) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in columns])
    rows = shown.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"
