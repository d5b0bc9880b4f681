"""Running totals in groups of any size: a group's rows need not fit in one task.

Rows are shuffled once, by ranges of (group, order), and written with the running totals of their
own range. A group that spans ranges has one row a range in a small table of what comes before it
there; adding that is a narrow pass over what was written. Only the first and the last group of a
range can span ranges, so that table has at most two rows a range and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verisieve.sources.tables import written

#: Rows of a range where the caller knows how many rows there are.
RANGE_ROWS = 1 << 20
#: Totals of groups with one row in so many, or more, are broadcast: at most that many groups.
HOT = 1000


def same(left: list[str], right: list[str]) -> Column:
    """Null-safe equality of columns, pair by pair; true without any."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)], F.lit(True))


def differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ, element by element; nulls are equal, and so are NaNs."""
    equal = pc.fill_null(pc.equal(a, b), False)
    if pa.types.is_floating(a.type):
        equal = pc.or_(equal, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    equal = pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~equal.to_numpy(zero_copy_only=False)


def _accumulated(v: np.ndarray, starts: np.ndarray, carry: float, step: np.ufunc) -> np.ndarray:
    """``step`` accumulated from each of ``starts``; what stands before the first goes on from ``carry``."""
    if step is np.add and v.dtype.kind == "i":
        out = np.cumsum(v)
        first = starts[0] if len(starts) else len(v)
        out[:first] += carry
        if len(starts):
            base = out[starts] - v[starts]
            out[first:] -= np.repeat(base, np.diff(np.append(starts, len(v))))
        return out
    out = np.empty_like(v)
    for a, b in zip([0, *starts], [*starts, len(v)]):
        if b > a:
            out[a:b] = step.accumulate(v[a:b])
            if a == 0 and not (len(starts) and starts[0] == 0):
                out[a:b] = step(out[a:b], carry)
    return out


def _local(rows: DataFrame, keys: list[str], sums: dict[str, str], mins: dict[str, str]) -> DataFrame:
    """``rows``, sorted in their partitions, with the partition's number ``_part`` and, for each
    group (``keys``), running sums and minima inside it. A null counts as nothing."""
    kinds = {n: T.LongType() if isinstance(rows.schema[c].dataType, T.IntegralType) else T.DoubleType() for n, c in sums.items()} | {n: T.DoubleType() for n in mins}
    source = sums | mins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carry = None, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            begins[0] = last is None
            for k in keys:
                c = b.column(k)
                begins[1:] |= differs(c.slice(1), c.slice(0, n - 1))
                if last is not None:
                    begins[0] |= differs(c.slice(0, 1), last[k])[0]
            starts = np.flatnonzero(begins)
            out = [pa.array(np.full(n, part, np.int32))]
            for name, c in source.items():
                whole = isinstance(kinds[name], T.LongType)
                nothing = 0 if name in sums else np.inf
                v = pc.fill_null(b.column(c).cast(pa.int64() if whole else pa.float64()), nothing).to_numpy(zero_copy_only=False)
                got = _accumulated(v, starts, carry.get(name, nothing), np.add if name in sums else np.minimum)
                carry[name] = got[-1]
                out.append(pa.array(got))
            last = {k: b.column(k).slice(n - 1, 1) for k in keys}
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, "__part", *source])

    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()), *[T.StructField(n, kinds[n]) for n in source]])
    return rows.mapInArrow(run, schema)


def _here(df: DataFrame) -> DataFrame:
    """A small table as literal rows, so that what reads it does not compute it again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def with_totals(df: DataFrame, by: list[str], wholes: dict[str, str]) -> DataFrame:
    """``df`` with sums (new column: column) over the rows of equal ``by``, nulls together; a null counts as nothing.

    The totals of up to 1,000 groups are literal rows and broadcast. Where there are more groups,
    those of groups with a thousandth of the rows or more are broadcast, so that their rows stay
    where they are; the rows of all others are shuffled."""
    names = [f"__by{i}" for i in range(len(by))]
    groups = [F.col(b).alias(n) for b, n in zip(by, names, strict=True)]
    totals = df.groupBy(*groups).agg(F.count("*").alias("__in_group"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in wholes.items()])
    few = totals.limit(HOT + 1).collect()
    if len(few) <= HOT:
        return df.join(F.broadcast(df.sparkSession.createDataFrame(few, totals.schema)), same(by, names)).drop(*names, "__in_group")
    least = max(1, df.count() // HOT)
    large, small = _here(totals.where(F.col("__in_group") >= least)), totals.where(F.col("__in_group") < least)
    here = df.join(F.broadcast(large), same(by, names))
    rest = df.join(F.broadcast(large), same(by, names), "left_anti").join(small, same(by, names))
    return here.unionByName(rest).drop(*names, "__in_group")


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str] | None = None, mins: dict[str, str] | None = None, wholes: dict[str, str] | None = None, reverse: bool = False, rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with inclusive running sums and minima (new column: column) in the order of ``order``,
    and ``wholes``, sums over the whole group.

    The result is a written table and its broadcast offsets: ``df`` is evaluated by the shuffle and
    by the sample that places the ranges, and never again. ``rows`` says how many rows there are,
    then each range gets about ``range_rows`` of them; without it there are as many ranges as
    shuffle partitions, fewer where they are small. ``reverse`` runs from the largest key. Sums are
    64-bit integers or doubles, minima doubles; a null counts as nothing. Rows of equal keys, which
    should not be in a group, share a range and are ordered at random. Zeros of either sign are one key,
    but two inside a key that is a struct, array or map.
    """
    sums, mins, wholes = sums or {}, mins or {}, wholes or {}
    atomic = {b: not isinstance(df.schema[b].dataType, (T.StructType, T.ArrayType, T.MapType)) for b in by}
    keys = [b if atomic[b] else f"__key{i}" for i, b in enumerate(by)]
    keyed = df.withColumns({k: F.to_json(F.struct(b)) for k, b in zip(keys, by, strict=True) if k != b})
    turn = [*[F.col(k) for k in keys], *[F.desc(c) if reverse else F.asc(c) for c in order]]
    parts = None if rows is None else max(1, -(-rows // range_rows))
    ranged = keyed.repartitionByRange(*turn) if parts is None else keyed.repartitionByRange(parts, *turn)
    laid = written(_local(ranged.sortWithinPartitions(*turn), keys, sums, mins))
    out = laid
    if parts != 1:
        # a group's rows in one range are summed there; what spans no ranges needs nothing
        names = [f"__by{i}" for i in range(len(by))]
        totals = laid.groupBy("__part", *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate(sums.values())], *[F.min(c).alias(f"__m{i}") for i, c in enumerate(mins.values())], F.count("*").alias("__rows"))
        before = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(F.col("__part").alias("__at"), *names, *[F.sum(f"__s{i}").over(before).alias(f"__s{i}") for i in range(len(sums))], *[F.min(f"__m{i}").over(before).alias(f"__m{i}") for i in range(len(mins))], F.sum("__rows").over(before).alias("__before")).where("__before > 0")
        offsets = _here(offsets)
        met = laid.join(F.broadcast(offsets), same(["__part", *keys], ["__at", *names]), "left")
        new = {n: F.col(n) + F.coalesce(F.col(f"__s{i}"), F.lit(0)) for i, n in enumerate(sums)}
        new |= {n: F.least(n, F.col(f"__m{i}").cast("double")) for i, n in enumerate(mins)}
        out = met.withColumns(new)
    out = out.withColumns({n: F.when(F.col(n) < float("inf"), F.col(n)) for n in mins})
    out = out.select(*df.columns, *sums, *mins)
    return with_totals(out, by, wholes) if wholes else out
