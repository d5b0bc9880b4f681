"""Leading components of feature arrays of any width, by subspace iteration over tiles.

Rows are written once as tiles: some rows by ``block`` features, dealt by rows into buckets, so a
join with what is known of those rows moves the small side only. With A the centred rows and Q an
orthonormal basis of a few more columns than wanted, a round is

* Y = A Q: tiles times the basis, which goes to the tasks in stripes of at most ``STRIPE`` numbers;
* Z = A' Y: tiles joined with the Y of their rows, summed by block of features, a stripe at a time;
* Q = Z made orthonormal by a tree of QR steps: blocks give triangles, which are stacked and
  factored ``FAN`` at a time until one is left for each group.

Y is centred by its own mean, which centres A. So no task and no driver ever holds features x
components numbers: a task holds a stripe or a few tiles, the driver a stripe or a triangle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisieve.operators import models
from verisieve.sources.buckets import write_bucketed
from verisieve.sources.tables import shared_folder, written

BLOCK = 1024
#: Numbers of a basis that are sent, or of sums that a task holds, at a time.
STRIPE = 1 << 22
#: Numbers of a tile's rows (all blocks) that a task holds while it cuts them.
TILE = 1 << 21
FAN = 64
#: Numbers of a bucket of tiles, and buckets at most.
BUCKET = 1 << 24
BUCKETS = 65_536


def _list(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel(), pa.float64()))


def _row(names: tuple[str, ...], *values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_list(v) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()) for v in values], list(names))


def _tiles(g: models.Groups, block: int) -> DataFrame:
    """group, chunk, block, rows, tile."""
    names = ("g", "chunk", "block", "rows", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[np.ndarray]] = {}

        def cut(group: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            x = np.concatenate(held.pop(group))
            for b in range(0, max(x.shape[1], 1), block):
                yield _row(names, group, task << 32 | made, b // block, len(x), np.ascontiguousarray(x[:, b : b + block]))
            made += 1

        for b in batches:
            groups = b.column("_g").to_numpy()
            for group in np.unique(groups):
                at = np.flatnonzero(groups == group)
                some = b.column("_x").take(pa.array(at))
                x = some.flatten().to_numpy().reshape(len(at), -1)
                most = max(1, TILE // max(x.shape[1], 1))
                for i in range(0, len(x), most):
                    held.setdefault(int(group), []).append(x[i : i + most])
                    if sum(map(len, held[group])) >= most:
                        yield from cut(int(group))
            while sum(p.size for parts in held.values() for p in parts) > 2 * TILE:  # many groups at once
                yield from cut(next(iter(held)))
        for group in list(held):
            yield from cut(group)

    return g.rows.mapInArrow(run, "g long, chunk long, block long, rows long, tile array<double>")


def _numbers(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return b.column(name)[i].values.to_numpy()


class Blocked:
    """Tiles of all groups and the passes over them. ``keys`` numbers (group, block) for sums."""

    def __init__(self, g: models.Groups, block: int):
        spark = g.rows.sparkSession
        self.widths, self.block = g.widths, block
        self.blocks = {i: -(-max(w, 1) // block) for i, w in enumerate(g.widths)}
        self.keys = {k: n for n, k in enumerate((i, b) for i, m in self.blocks.items() for b in range(m))}
        self.of = {n: k for k, n in self.keys.items()}
        self.tasks = min(BUCKETS, max(1, g.numbers // BUCKET))
        self.tiles = write_bucketed(_tiles(g, block), f"{shared_folder(spark)}/{uuid.uuid4().hex}", ["g", "chunk"], self.tasks)

    def width(self, group: int, block: int) -> int:
        return min(self.block, self.widths[group] - block * self.block)

    def stripes(self, l: dict[int, int]) -> list[list[int]]:
        """Numbers of (group, block), so many at a time that their part of a basis fits."""
        out: list[list[int]] = [[]]
        size = 0
        for n, (i, b) in self.of.items():
            more = self.width(i, b) * l[i]
            if size + more > STRIPE and out[-1]:
                out.append([])
                size = 0
            out[-1].append(n)
            size += more
        return out

    def moments(self) -> tuple[dict[int, int], DataFrame]:
        """Rows of each group, and sums of each block's features (_m, v)."""
        keys = self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            for b in batches:
                for i in range(b.num_rows):
                    g, k, n = (b.column(c)[i].as_py() for c in ("g", "block", "rows"))
                    yield pa.RecordBatch.from_arrays([pa.array([keys[g, k]], pa.int32()), pa.array([task], pa.int32()), _list(np.append(n, _numbers(b, "tile", i).reshape(n, -1).sum(0)))], ["_m", "_t", "v"])

        sums = written(models.added(self.tiles.mapInArrow(run, models.SUMS), self.tasks).select("_m", "v"))
        first = [n for n, (_, b) in self.of.items() if b == 0]
        return {self.of[r._m][0]: int(r.n) for r in sums.where(F.col("_m").isin(first)).select("_m", F.col("v")[0].alias("n")).collect()}, sums

    def forward(self, basis: dict[int, np.ndarray] | DataFrame, l: dict[int, int]) -> DataFrame:
        """g, chunk, y: rows times the basis, not centred. ``basis`` (_m, v) is read a stripe at a time."""
        keys, made = self.keys, []
        for stripe in self.stripes(l):
            part = {r._m: np.array(r.v) for r in basis.where(F.col("_m").isin(stripe)).collect()}
            part = {n: v.reshape(self.width(*self.of[n]), -1) for n, v in part.items()}
            wanted = F.lit(True) if len(stripe) == len(keys) else F.struct("g", "block").isin(*[F.struct(F.lit(i).cast("long"), F.lit(b).cast("long")) for i, b in (self.of[n] for n in stripe)])

            def run(batches: Iterator[pa.RecordBatch], part: dict[int, np.ndarray] = part) -> Iterator[pa.RecordBatch]:
                now, y = None, None
                for b in batches:
                    for i in range(b.num_rows):
                        g, chunk, k, n = (b.column(c)[i].as_py() for c in ("g", "chunk", "block", "rows"))
                        if (g, chunk) != now:
                            if now is not None:
                                yield _row(("g", "chunk", "y"), *now, y)
                            now, y = (g, chunk), 0.0
                        y = y + _numbers(b, "tile", i).reshape(n, -1) @ part[keys[g, k]]
                if now is not None:
                    yield _row(("g", "chunk", "y"), *now, y)

            made.append(written(self.tiles.where(wanted).sortWithinPartitions("g", "chunk", "block").mapInArrow(run, "g long, chunk long, y array<double>")))
        if len(made) == 1:
            return made[0]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, y = None, None
            for b in batches:
                for i in range(b.num_rows):
                    key, one = (b.column("g")[i].as_py(), b.column("chunk")[i].as_py()), _numbers(b, "y", i)
                    if key != now and now is not None:
                        yield _row(("g", "chunk", "y"), *now, y)
                    now, y = key, y + one if key == now else one
            if now is not None:
                yield _row(("g", "chunk", "y"), *now, y)

        all_ = reduce(DataFrame.unionByName, made)
        return written(all_.repartition("g", "chunk").sortWithinPartitions("g", "chunk").mapInArrow(add, "g long, chunk long, y array<double>"))

    def summed(self, y: DataFrame, l: dict[int, int], centre: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        """Of each group the sum of the rows of y or, around ``centre``, of their products."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, found = TaskContext.get().partitionId(), {}
            for b in batches:
                for i in range(b.num_rows):
                    g = b.column("g")[i].as_py()
                    v = _numbers(b, "y", i).reshape(-1, l[g])
                    v = v.sum(0) if centre is None else ((v - centre[g]).T @ (v - centre[g])).ravel()
                    found[g] = found[g] + v if g in found else v
            for g, v in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([task], pa.int32()), _list(v)], ["_m", "_t", "v"])

        return {r._m: np.array(r.v) for r in models.added(y.mapInArrow(run, models.SUMS), self.tasks).collect()}

    def back(self, y: DataFrame, l: dict[int, int], centre: dict[int, np.ndarray]) -> DataFrame:
        """_m, v: transposed rows times the centred y, by block of features."""
        keys, made = self.keys, []
        for stripe in self.stripes(l):
            mine = set(stripe)

            def run(batches: Iterator[pa.RecordBatch], mine: set[int] = mine) -> Iterator[pa.RecordBatch]:
                task, found = TaskContext.get().partitionId(), {}
                for b in batches:
                    for i in range(b.num_rows):
                        g, k, n = (b.column(c)[i].as_py() for c in ("g", "block", "rows"))
                        m = keys[g, k]
                        if m in mine:
                            v = _numbers(b, "tile", i).reshape(n, -1).T @ (_numbers(b, "y", i).reshape(n, -1) - centre[g])
                            found[m] = found[m] + v if m in found else v
                for m, v in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([task], pa.int32()), _list(v)], ["_m", "_t", "v"])

            wanted = F.struct("g", "block").isin(*[F.struct(F.lit(i).cast("long"), F.lit(b).cast("long")) for i, b in (self.of[n] for n in stripe)])
            tiles = self.tiles if len(stripe) == len(keys) else self.tiles.where(wanted)
            met = tiles.join(y, ["g", "chunk"]).select("g", "block", "rows", "tile", "y")
            made.append(written(models.added(met.mapInArrow(run, models.SUMS), self.tasks).select("_m", "v")))
        return reduce(DataFrame.unionByName, made)

    def orthonormal(self, z: DataFrame, l: dict[int, int], times: int = 1) -> tuple[DataFrame, dict[int, int]]:
        """An orthonormal basis of the columns of z, and how many it has; a second time takes away
        what rounding leaves."""
        for _ in range(times):
            turn = self._turns(z, l)
            l = {i: t.shape[1] for i, t in turn.items()}
            z = self._turned(z, turn)
        return z, l

    def _turns(self, z: DataFrame, l: dict[int, int]) -> dict[int, np.ndarray]:
        of = self.of

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    g, k = of[b.column("_m")[i].as_py()]
                    r = np.linalg.qr(_numbers(b, "v", i).reshape(-1, l[g]), mode="r")
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([k], pa.int32()), _list(r)], ["_m", "_t", "v"])

        def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, r = None, None
            for b in batches:
                for i in range(b.num_rows):
                    key = (b.column("_m")[i].as_py(), b.column("_t")[i].as_py())
                    one = _numbers(b, "v", i).reshape(-1, l[key[0]])
                    if key != now and now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), _list(r)], ["_m", "_t", "v"])
                    r = np.linalg.qr(np.concatenate([r, one]), mode="r") if key == now else one
                    now = key
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), _list(r)], ["_m", "_t", "v"])

        triangles, blocks = z.mapInArrow(first, models.SUMS), max(self.blocks.values(), default=1)
        while True:
            blocks = -(-blocks // FAN)
            triangles = triangles.withColumn("_t", F.floor(F.col("_t") / FAN).cast("int")).repartition("_m", "_t").sortWithinPartitions("_m", "_t").mapInArrow(stack, models.SUMS)
            if blocks == 1:
                break
        out = {}
        for r in triangles.collect():  # one for each group
            _, s, vt = np.linalg.svd(np.array(r.v).reshape(-1, l[r._m]))
            s = np.append(s, np.zeros(max(0, l[r._m] - len(s))))
            keep = s > max(s[:1].max(initial=0.0) * 1e-10, 1e-300)
            keep[0] |= not keep.any()
            out[r._m] = vt.T[:, keep] / np.where(s[keep] > 0, s[keep], 1.0)
        return out

    def _turned(self, z: DataFrame, turn: dict[int, np.ndarray]) -> DataFrame:
        of = self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    m = b.column("_m")[i].as_py()
                    t = turn[of[m][0]]
                    yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), _list(_numbers(b, "v", i).reshape(-1, len(t)) @ t)], ["_m", "v"])

        return z.mapInArrow(run, "_m int, v array<double>")

    def random(self, l: dict[int, int], seed: int, spark: object) -> DataFrame:
        """A first basis, made in tasks from the seed and the place."""
        places = [(n, self.width(*self.of[n]), l[self.of[n][0]]) for n in self.of if self.of[n][0] in l]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, w, k in zip(*(b.column(c).to_pylist() for c in ("n", "w", "k"))):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), _list(np.random.default_rng([seed, n]).standard_normal((w, k)))], ["_m", "v"])

        return spark.createDataFrame(places, "n int, w int, k int").mapInArrow(run, "_m int, v array<double>")


def fit_components(df: DataFrame, by: list[str], dim: int = 100, features: str = "x", extra: int = 10, rounds: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """by, block, mu, components, variance: a row for each group and block of features.

    ``mu`` and ``components`` (each an array) are of the block's features, ``variance`` of the group.
    ``dim`` is cut to the features and to the rows less one. The largest number of each component is positive.
    """
    g = models.Groups(df, by, features, None)
    spark = df.sparkSession
    out = "block int, mu array<double>, components array<array<double>>, variance array<double>"
    if not g.keys:
        return models.local(df, by, [], out)
    a = Blocked(g, block)
    n, sums = a.moments()
    k = {i: min(g.widths[i], dim, max(1, n[i] - 1)) for i in n}
    l = {i: min(g.widths[i], k[i] + extra) for i in n}
    q, l = a.orthonormal(written(a.random(l, seed, spark)), l)
    for left in reversed(range(rounds)):
        y = a.forward(q, l)
        centre = {i: s / n[i] for i, s in a.summed(y, l, None).items()}
        q, l = a.orthonormal(a.back(y, l, centre), l, 1 if left else 2)
    y = a.forward(q, l)
    centre = {i: s / n[i] for i, s in a.summed(y, l, None).items()}
    turn, variance = {}, {}
    for i, v in a.summed(y, l, centre).items():
        values, vectors = np.linalg.eigh(v.reshape(l[i], l[i]))
        top = np.argsort(-values)[: k[i]]
        turn[i], variance[i] = vectors[:, top], np.maximum(values[top], 0) / n[i]
    axes = written(a._turned(q, turn))
    peaks = axes.mapInArrow(_peaks({m: len(variance[i]) for m, (i, _) in a.of.items()}), "_m int, v array<double>")
    best: dict[int, np.ndarray] = {}
    for r in peaks.collect():  # one number for each component of a block
        v, i = np.array(r.v), a.of[r._m][0]
        best[i] = v if i not in best else np.where(np.abs(v) > np.abs(best[i]), v, best[i])
    sign = {i: np.where(v < 0, -1.0, 1.0) for i, v in best.items()}
    of, keys, kinds = a.of, g.keys, [f.dataType for f in df.select(*by).schema]
    names = [f"_k{i}" for i in range(len(by))]
    labels = spark.createDataFrame([(*keys[i], i) for i in range(len(keys))], T.StructType([*[T.StructField(m, t) for m, t in zip(names, kinds)], T.StructField("_g", T.IntegerType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                i, at = of[b.column("_m")[r].as_py()]
                one = (_numbers(b, "v", r).reshape(-1, len(sign[i])) * sign[i]).T
                mu = _numbers(b, "s", r)[1:] / n[i]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1, dtype=np.int32) * one.shape[1]), pa.array(one.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int32()), _list(mu), pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists), _list(variance[i])], ["_g", "block", "mu", "components", "variance"])

    both = axes.join(sums.withColumnRenamed("v", "s"), "_m")
    made = both.mapInArrow(run, f"_g int, {out}")
    return written(made.join(F.broadcast(labels), "_g").select(*[F.col(m).alias(c) for m, c in zip(names, by)], "block", "mu", "components", "variance"))


def _peaks(count: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                m = b.column("_m")[i].as_py()
                v = _numbers(b, "v", i).reshape(-1, count[m])
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), _list(v[np.abs(v).argmax(0), np.arange(v.shape[1])])], ["_m", "v"])

    return run


def project(df: DataFrame, model: DataFrame, by: list[str], features: str = "x", out: str = "x") -> DataFrame:
    """Coordinates along the components of ``fit_components``; rows of groups without any are left out,
    those whose features are not of the model's length, or hold null or NaN, get null. Blocks go to the tasks in stripes
    of at most ``STRIPE`` numbers, and the coordinates so far are written between stripes."""
    sizes = model.select(*by, "block", F.size("mu").alias("w"), (F.size("mu") * (1 + F.size("components"))).alias("n")).collect()
    spark, names = df.sparkSession, [f"_k{i}" for i in range(len(by))]
    keys = sorted({tuple(r[b] for b in by) for r in sizes}, key=repr)
    number = {k: i for i, k in enumerate(keys)}
    width: dict[int, int] = {}
    wide: dict[int, list[tuple[int, int]]] = {}
    stripes: list[list[tuple[int, int]]] = [[]]
    held = 0
    for r in sorted(sizes, key=lambda r: (number[tuple(r[b] for b in by)], r.block)):
        i = number[tuple(r[b] for b in by)]
        width[i] = width.get(i, 0) + r.w
        wide.setdefault(i, []).append((r.block, r.w))
        if held + r.n > STRIPE and stripes[-1]:
            stripes.append([])
            held = 0
        stripes[-1].append((i, r.block))
        held += r.n
    kinds = [f.dataType for f in df.select(*by).schema]
    labels = spark.createDataFrame([(*k, i) for k, i in number.items()], T.StructType([*[T.StructField(m, t) for m, t in zip(names, kinds)], T.StructField("_g", T.IntegerType())]))
    on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(m)) for b, m in zip(by, names)], F.lit(True))
    rows = df.join(F.broadcast(labels), on).drop(*names).withColumns({"_in": F.col(features).cast("array<double>"), "_out": F.lit(None).cast("array<double>")})
    numbered = model.join(F.broadcast(labels), on).drop(*names)
    for s, stripe in enumerate(stripes):
        mine = numbered.where(F.struct("_g", "block").isin(*[F.struct(F.lit(i), F.lit(b)) for i, b in stripe])) if len(stripes) > 1 else numbered
        part = {(r._g, r.block): (np.array(r.mu), np.array(r.components)) for r in mine.collect()}
        starts = {k: sum(w for b, w in wide[k[0]] if b < k[1]) for k in part}

        def run(batches: Iterator[pa.RecordBatch], part: dict = part, starts: dict = starts, last: bool = s + 1 == len(stripes)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                groups, lists, so = b.column("_g").to_numpy(), b.column("_in"), b.column("_out")
                sound = lists.value_lengths().fill_null(-1).to_numpy() == np.array([width[g] for g in groups])
                got: list[np.ndarray | None] = [None] * b.num_rows
                for g in np.unique(groups[sound]):
                    at = np.flatnonzero(sound & (groups == g))
                    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    v = np.stack([so[int(i)].values.to_numpy() for i in at]) if so[int(at[0])].is_valid else 0.0
                    for (i, k), (mu, axes) in part.items():
                        if i == g:
                            v = v + (x[:, starts[i, k] : starts[i, k] + len(mu)] - mu) @ axes.T
                    for i, one in zip(at, v if isinstance(v, np.ndarray) else []):
                        got[i] = None if last and np.isnan(one).any() else one
                place = b.schema.get_field_index("_out")
                yield b.set_column(place, b.schema.field(place), pa.array(got, pa.list_(pa.float64())))

        rows = rows.mapInArrow(run, rows.schema)
        if s + 1 < len(stripes):
            rows = written(rows)
    kept = [c for c in df.columns if c != out]
    return rows.select(*kept, F.col("_out").alias(out))
