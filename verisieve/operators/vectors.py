"""Component-wise statistics of vectors, as aggregates of whole arrays.

A task sums the vectors of each group in a batch to three arrays: how many values a component
has, their mean, and the sum of squares around it. Such arrays are merged pairwise without loss
(mean and squares are shifted to the common mean), first those of a group that meet in a
partition, so no vector is taken apart into rows and no group comes together anywhere.

A null component counts as no value of it, and a vector shorter than others of its group has none
behind its end; a component without values has null. NaN and infinite values spread as in sums.
Null vectors are left out; a group of nothing else has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisieve.operators.running import differs

PARTS = ("_n", "_mean", "_m2")


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of a matrix, zeros where there is no value, and where there is one."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    width = int(sizes.max(initial=0))
    there = np.arange(width) < sizes[:, None]
    x = np.zeros(there.shape)
    x[there] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        there[there] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    return x, there


def _begins(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = b.column(k)
        new[1:] |= differs(c.slice(1), c.slice(0, b.num_rows - 1))
    return np.flatnonzero(new)


def _out(b: pa.RecordBatch, keys: list[str], at: np.ndarray, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> pa.RecordBatch:
    width = n.shape[1]
    where = pa.array(np.arange(len(at) + 1, dtype=np.int32) * width)
    lists = [pa.ListArray.from_arrays(where, pa.array(m.ravel())) for m in (n, mean, m2)]
    return pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at)) for k in keys], *lists], [*keys, *PARTS])


def _first(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial arrays of the groups of each batch."""
    for b in batches:
        for cut in range(0, b.num_rows, 4096):
            some = b.slice(cut, 4096)
            if keys:
                index = pa.table({**{k: some.column(k) for k in keys}, "_row": pa.array(np.arange(some.num_rows))}).sort_by([(k, "ascending") for k in keys])["_row"]
                some = some.take(index.combine_chunks())
            at = _begins(some, keys)
            x, there = _matrix(some.column("_v"))
            n = np.add.reduceat(there.astype(float), at, axis=0)
            mean = np.add.reduceat(x, at, axis=0) / np.maximum(n, 1)
            apart = np.where(there, x - np.repeat(mean, np.diff(np.append(at, len(x))), axis=0), 0)
            yield _out(some, keys, at, n, mean, np.add.reduceat(apart * apart, at, axis=0))


def _merged(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial arrays of equal keys, which come one after another, as one."""
    held: pa.RecordBatch | None = None
    for b in batches:
        for cut in range(0, b.num_rows, 1024):
            some = b.slice(cut, 1024)
            if held is not None:
                some = pa.Table.from_batches([held, some]).combine_chunks().to_batches()[0]
            at = _begins(some, keys)
            n, mean, m2 = (_matrix(some.column(c))[0] for c in PARTS)
            total = np.add.reduceat(n, at, axis=0)
            common = np.add.reduceat(n * mean, at, axis=0) / np.maximum(total, 1)
            apart = np.where(n > 0, mean - np.repeat(common, np.diff(np.append(at, len(n))), axis=0), 0)
            done = _out(some, keys, at, total, common, np.add.reduceat(m2 + n * apart * apart, at, axis=0))
            if done.num_rows > 1:
                yield done.slice(0, done.num_rows - 1)
            held = done.slice(done.num_rows - 1)
    if held is not None:
        yield held


def vector_stats(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by, n, mean, m2: arrays of the values of each component, their mean and the sum of squares around it."""
    flat = {b: not isinstance(df.schema[b].dataType, (T.StructType, T.ArrayType, T.MapType)) for b in by}
    if not all(flat.values()):
        raise ValueError("groups of vectors are told by plain columns")
    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(vector).cast("array<double>").alias("_v"))
    schema = T.StructType([*[rows.schema[b] for b in by], *[T.StructField(p, T.ArrayType(T.DoubleType())) for p in PARTS]])
    partial = rows.mapInArrow(lambda batches: _first(batches, by), schema)
    met = partial.repartition(*by).sortWithinPartitions(*by) if by else partial.coalesce(1)
    out = met.mapInArrow(lambda batches: _merged(batches, by), schema)
    value = lambda c: F.zip_with("_n", c, lambda n, v: F.when(n > 0, v))
    return out.select(*by, F.col("_n").alias("n"), value("_mean").alias("mean"), value("_m2").alias("m2"))


def mean_and_deviation(df: DataFrame, by: list[str], vector: str, floor: float = 0.0) -> DataFrame:
    """by, mu, sigma: arrays of the mean and the population deviation (plus ``floor``) of each component."""
    sigma = F.zip_with("m2", "n", lambda s, n: F.sqrt(s / n) + floor)
    return vector_stats(df, by, vector).select(*by, F.col("mean").alias("mu"), sigma.alias("sigma"))
