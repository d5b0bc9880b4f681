"""Vector codes by parts: Lloyd's iteration in integers, pruned by Hamerly's bounds.

A component x becomes floor(1024 * x). A vector is cut into equal consecutive parts; each part
position has a codebook, which starts as that part of the vectors of the smallest ids. A round
assigns every part to its nearest entry (ties to the lower index) and replaces each entry by the
floored mean of its parts; unused entries stay.

Besides its code a part keeps two numbers from round to round: an upper bound of the distance to
its entry and a lower bound of the distance to every other entry. Entries that move by d loosen
them by d. While the upper bound is strictly below the lower one, or below half the distance from
the entry to the entry next to it, no other entry is as near, and nothing is computed. Otherwise
the distance to its entry is taken anew, and only if that does not settle it, all distances are,
in integers. Bounds are rounded outwards, so they never decide a tie.

The vectors with their codes and bounds are written to the shared folder after every round and the
table before is deleted: a lost executor costs its tasks of one round. The driver holds the
codebooks (``entries`` vectors) and nothing that grows with the rows.

Rows whose vector is null or holds null or non-finite components are left out. A vector shorter
than the longest, or than a multiple of ``parts``, counts as having zeros behind it; an empty one
is all zeros. Components beyond 16,384 count as that (so that sums of 2**39 rows fit 64 bits);
vectors longer than 32,768 raise an error. Rows of equal ids are rows of their own, ordered by
their components where they start a codebook, null ids last. Fewer rows than ``entries`` give
smaller codebooks, an empty table no rows. Null labels are one label. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from verisieve.llm.common import forget, stash, table

SCALE, MOST, LONGEST = 1024, 1 << 24, 32_768
OUT, IN = 1 + 1e-12, 1 - 1e-12
#: Groups of more than this share of the rows have their totals broadcast: at most 1,000 of them.
HOT = 1000


def _numbers(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = m.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(m) + 1) * width, max(width, 1), dtype=np.int32)[: len(m) + 1] if width else np.zeros(len(m) + 1, np.int32)), pa.array(m.ravel(), kind))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches cut small, so that what is computed for one at a time is bounded."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def quantised(embeddings: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, label, v``: integer vectors of one length, a multiple of ``parts``."""
    x = F.col(vector_col).cast("array<double>")
    sound = embeddings.where(F.col(vector_col).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    rows = sound.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))
    longest = rows.agg(F.max(F.size("x"))).head()[0] or 0
    if longest > LONGEST:
        raise ValueError(f"vectors of {longest} components, over {LONGEST}")
    width = -(-longest // parts) * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            lists = b.column("x")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            v = np.zeros((len(lists), width), np.int32)
            v[np.arange(width) < sizes[:, None]] = np.clip(np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE), -MOST, MOST)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _lists(v, pa.int32())], ["vec_id", "label", "v"])

    schema = StructType([rows.schema["vec_id"], rows.schema["label"], StructField("v", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 52:  # then every step is exact in doubles
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for k, entry in enumerate(c):
        out[:, k] = ((x - entry) ** 2).sum(axis=1)
    return out


class Book:
    """One part position's entries, with what the bounds need: how far each entry moved in the
    last step and half its distance to the next entry."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = _squares(entries, entries).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(axis=1, initial=np.inf)) / 2 * IN
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64)) * OUT
        self.moved = moved
        self.first = int(moved.argmax()) if len(moved) else 0
        others = np.delete(moved, self.first)
        self.most, self.next = (moved[self.first] if len(moved) else 0.0), others.max(initial=0.0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, bound of its distance from above, bound of all others' from below."""
        d = _squares(x, self.entries)
        code = d.argmin(axis=1)
        rows = np.arange(len(x))
        own = d[rows, code]
        if d.shape[1] == 1:
            rest = np.full(len(x), np.inf)
        else:
            d[rows, code] = np.iinfo(np.int64).max
            rest = d.min(axis=1).astype(np.float64)
        return code, np.sqrt(own.astype(np.float64)) * OUT, np.sqrt(rest) * IN

    def own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        return ((x - self.entries[code]) ** 2).sum(axis=1)

    def update(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bring code and bounds up to date in place; the rows for which all distances were taken."""
        upper += self.moved[code]
        upper *= OUT
        lower -= np.where(code == self.first, self.next, self.most)
        lower -= np.where(np.isinf(lower), 0.0, np.abs(lower)) * (1 - IN)
        safe = np.maximum(lower, self.half[code])
        open_ = np.flatnonzero(~(upper < safe))
        upper[open_] = np.sqrt(self.own(x[open_], code[open_]).astype(np.float64)) * OUT
        full = open_[~(upper[open_] < safe[open_])]
        if len(full):
            code[full], upper[full], lower[full] = self.nearest(x[full])
        return full


def _assigned(state: DataFrame, books: list[Book], begun: bool) -> DataFrame:
    """``state`` with its codes and bounds brought up to date with ``books``."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            n = b.num_rows
            v = _numbers(b.column("v"), np.int64).reshape(n, parts, -1)
            if begun:
                code, upper, lower = (_numbers(b.column(c), k).copy() for c, k in (("code", np.int64), ("upper", np.float64), ("lower", np.float64)))
                scans = b.column("full_scans").to_numpy().copy()
            else:
                code, upper, lower, scans = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts)), np.zeros(n, np.int64)
            for p, book in enumerate(books):
                x = v[:, p]
                if begun:
                    own = [np.ascontiguousarray(m[:, p]) for m in (code, upper, lower)]
                    scans[book.update(x, *own)] += 1
                else:
                    own = book.nearest(x)
                    scans += 1
                code[:, p], upper[:, p], lower[:, p] = own
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), b.column("v"), _lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), pa.array(scans)],
                ["vec_id", "label", "v", "code", "upper", "lower", "full_scans"],
            )

    kept = [state.schema[c] for c in ("vec_id", "label", "v")]
    more = "code array<int>, upper array<double>, lower array<double>, full_scans long"
    schema = StructType([*kept, *StructType.fromDDL(more)])
    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """For each part, entry: number of parts (in front) and sums of their components. Tasks send a
    row for each entry they met, tasks again add those of an entry, the driver gets one for each."""
    schema = "part int, entry int, sums array<long>"
    size = width // parts

    def rows(total: np.ndarray) -> pa.RecordBatch:
        part, entry = np.nonzero(total[:, :, 0])
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), _lists(total[part, entry], pa.int64())], ["part", "entry", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, size + 1), np.int64)
        for b in _pieces(batches):
            v = _numbers(b.column("v"), np.int64).reshape(b.num_rows, parts, -1)
            code = _numbers(b.column("code"), np.int64)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                at = np.flatnonzero(np.diff(code[order, p], prepend=-1))
                if len(at):
                    met = code[order[at], p]
                    total[p, met, 0] += np.diff(at, append=len(order))
                    total[p, met, 1:] += np.add.reduceat(v[order, p], at, axis=0)
        yield rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, size + 1), np.int64)
        for b in _pieces(batches):
            np.add.at(total, (b.column("part").to_numpy(), b.column("entry").to_numpy()), _numbers(b.column("sums"), np.int64))
        yield rows(total)

    out = np.zeros((parts, entries, size + 1), np.int64)
    for r in state.select("v", "code").mapInArrow(count, schema).repartition("part", "entry").mapInArrow(add, schema).collect():
        out[r.part, r.entry] = r.sums
    return out


def part_codes(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code (array), error, full_scans`` for every sound vector, and the codebooks
    as parts x entries x components. ``full_scans`` counts for how many of its parts, over all
    assignments, all distances were taken."""
    state = stash(quantised(embeddings, parts, id_col, vector_col, label_col))
    seeds = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not seeds:
        schema = StructType([state.schema["vec_id"], state.schema["label"], StructField("code", ArrayType(IntegerType())), StructField("error", LongType()), StructField("full_scans", LongType())])
        return state.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = len(seeds[0].v)
    books = np.array([s.v for s in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    before = None
    for done in range(rounds):
        now = stash(_assigned(state, [Book(books[p], None if before is None else before[p]) for p in range(parts)], done > 0))
        forget(state)
        state, sums = now, _sums(now, parts, len(seeds), width)
        counts = sums[:, :, :1]
        before, books = books, np.where(counts > 0, sums[:, :, 1:] // np.maximum(counts, 1), books)
    final = [Book(books[p], None if before is None else before[p]) for p in range(parts)]
    last = _assigned(state, final, rounds > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            v = _numbers(b.column("v"), np.int64).reshape(b.num_rows, parts, -1)
            code = _numbers(b.column("code"), np.int64)
            error = sum(book.own(v[:, p], code[:, p]) for p, book in enumerate(final))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("code"), pa.array(error, pa.int64()), b.column("full_scans")], ["vec_id", "label", "code", "error", "full_scans"])

    schema = StructType([*(last.schema[c] for c in ("vec_id", "label", "code")), StructField("error", LongType()), last.schema["full_scans"]])
    out = stash(last.mapInArrow(run, schema))
    forget(state)
    return out, books


def with_group_total(rows: DataFrame, key: str, value: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of equal ``key``, nulls together.

    Groups with a thousandth of the rows or more, of which there are at most 1,000, are joined by
    broadcast, so their rows stay where they are; the rows of all others are shuffled."""
    least = max(1, rows.count() // HOT)
    totals = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(total), F.count("*").alias("_rows"))
    match = F.col(key).eqNullSafe(F.col("_key"))
    large, small = totals.where(F.col("_rows") >= least), totals.where(F.col("_rows") < least)
    there = rows.join(F.broadcast(large), match)
    rest = rows.join(F.broadcast(large), match, "left_anti").join(small, match)
    return there.unionByName(rest).drop("_key", "_rows")


def book_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = part_codes(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    coded = with_group_total(rows.withColumn("code", code), "label", "error", "label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(book_hash(books)).alias("codebooks_sha256"))


def _op11_sql() -> str:
    """Plain Lloyd over all distances."""
    sql = """WITH q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT n, vec_id, label, CAST(p AS INTEGER) AS p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM q, range(4) t(p)
), book0 AS MATERIALIZED (
  SELECT p, n - 1 AS k, x AS c FROM parts WHERE n <= 256
)"""
    for r in range(5):
        sql += f""", near{r} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(label) AS label, p, any_value(x) AS x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'k': k}}) AS best
  FROM parts JOIN book{r} USING (p) GROUP BY n, p
)"""
        if r < 4:
            sql += f""", sums{r} AS MATERIALIZED (
  SELECT p, k, list(m ORDER BY i) AS c FROM (
    SELECT p, best.k AS k, i, CAST(floor(sum(CAST(x[i] AS BIGINT)) / count(*)) AS DOUBLE) AS m FROM near{r}, range(1, 1 + (SELECT max(len(x)) FROM parts)) t(i) GROUP BY ALL
  ) GROUP BY p, k
), book{r + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(s.c, b.c) AS c FROM book{r} b LEFT JOIN sums{r} s USING (p, k)
)"""
    return sql + """, coded AS (
  SELECT n, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near4 GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN c], ','), ',' ORDER BY p, k)) FROM book4) AS codebooks_sha256
FROM coded"""


OP11_SQL = _op11_sql()
