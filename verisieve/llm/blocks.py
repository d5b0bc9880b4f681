"""Bounded tasks for comparing the members of groups of any size.

A group of up to ``size`` members is one task. A larger one is dealt into blocks, and
every pair of blocks is a task, so each task holds two blocks at most and each pair of
members meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(members: DataFrame, keys: list[str], member: str, size: int) -> DataFrame:
    """``members`` with int columns ``block_i`` <= ``block_j`` (the task) and ``side`` (its block).

    Groups of one member are left out."""
    counts = members.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / size).cast("int")).drop("_n")
    dealt = members.join(counts, keys).withColumn("side", F.pmod(F.xxhash64(member, F.lit(7)), F.col("_blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    out = dealt.withColumn("_other", F.explode(others))
    return out.withColumn("block_i", F.least("side", "_other")).withColumn("block_j", F.greatest("side", "_other")).drop("_other", "_blocks")


def spread(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one task together and in order, in one partition."""
    by = [*keys, "block_i", "block_j"]
    return tasks.repartition(*by).sortWithinPartitions(*by)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by their first ``n_keys`` columns: tables of whole groups, with
    the places where groups begin (and the end)."""
    held: list[pa.RecordBatch] = []

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in range(n_keys):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        same = all(batch.column(c)[0] == batch.column(c)[batch.num_rows - 1] and held[0].column(c)[0] == batch.column(c)[0] for c in range(n_keys))
        if same:
            continue
        t = pa.Table.from_batches(held)
        at = cuts(t)
        if len(at) > 2:
            yield t.slice(0, int(at[-2])), at[:-1]
            held = t.slice(int(at[-2])).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        if t.num_rows:
            yield t, cuts(t)


def least_labels(hit: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index that each row is linked with."""
    n = len(hit)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new
