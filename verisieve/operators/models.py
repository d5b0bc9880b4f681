"""Fitted models over feature arrays: logistic regression, projections, cross-validation.

Every pass sums small arrays inside the tasks and adds them up in the cluster, so that the driver
sees exactly one array for each model, however many tasks there are. Groups are a configured
dimension (pair, configuration, band), at most ``MOST_GROUPS``; rows of a group are never brought
together, so one group may hold any share of the rows. Models that share rows (folds, strengths,
choices of columns) are fitted from one reading of them in each pass.

Rows whose features are null, of another length than most of their group's, or not finite, or whose label
is null, are not fitted; such rows get no probability either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisieve.functions import arrays as A
from verisieve.operators import ranks
from verisieve.operators import relational as rel
from verisieve.sources.tables import written

MOST_GROUPS = 10_000
#: Features up to this number are fitted by Newton steps, more by gradients alone.
MOST_SQUARE = 256
#: Numbers that the driver holds in one pass; where Newton steps would need more, gradients are used.
MOST_HELD = 1 << 25
#: Numbers in models that are broadcast; larger ones are joined by shuffle.
MOST_SENT = 1 << 22
#: Tasks whose sums are added at a time.
FAN = 256
#: Numbers of features that a task works on at a time.
AT_ONCE = 1 << 21

Kernel = Callable[[np.ndarray, np.ndarray, object], np.ndarray]


def usable(x: Column) -> Column:
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


class Model(NamedTuple):
    """What is fitted: the rows of a group but for those of a fold, and some of the columns."""

    group: int
    fold: int | None = None
    columns: tuple[int, ...] | None = None


def _arrays(values: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0), pa.float64()))


SUMS = "_m int, _t int, v array<double>"


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of equal _m, _t added up; they come one after another."""
    now, total = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), _arrays([total])], ["_m", "_t", "v"])

    for b in batches:
        ms, ts, v = b.column("_m").to_pylist(), b.column("_t").to_pylist(), b.column("v")
        for i, key in enumerate(zip(ms, ts)):
            one = v[i].values.to_numpy()
            if key == now:
                total += one
                continue
            if now is not None:
                yield row()
            now, total = key, one.copy()
    if now is not None:
        yield row()


class Groups:
    """Rows numbered by group, written once, and sums over them."""

    def __init__(self, df: DataFrame, by: list[str], features: str, y: str | None, fold: str | None = None):
        spark = df.sparkSession
        self.tasks: int | None = None
        x = F.col(features).cast("array<double>")
        label = F.col(y).cast("double") if y else F.lit(0.0)
        part = F.col(fold).cast("int") if fold else F.lit(0)
        names = [f"_k{i}" for i in range(len(by))]
        chosen = df.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], x.alias("_x"), label.alias("_y"), part.alias("_f"))
        base = written(chosen.where(usable(F.col("_x")) & F.col("_y").isNotNull()))
        sizes = base.groupBy(*names, F.size("_x").alias("_w")).count().limit(4 * MOST_GROUPS + 1).collect()
        most: dict[tuple, tuple[int, int]] = {}
        for r in sizes:
            key = tuple(r[n] for n in names)
            most[key] = max(most.get(key, (0, 0)), (r["count"], -r["_w"]))
        if len(sizes) > 4 * MOST_GROUPS or len(most) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups to fit")
        self.keys = sorted(most, key=repr)
        #: Features of each group: the length that most of its rows have.
        self.widths = [-most[k][1] for k in self.keys]
        #: Numbers in all rows' features.
        self.numbers = sum(most[k][0] * -most[k][1] for k in self.keys)
        kinds = [T.StructField(f"_i{i}", f.dataType) for i, f in enumerate(df.select(*by).schema)] if by else []
        ids = spark.createDataFrame([(*k, i, w) for i, (k, w) in enumerate(zip(self.keys, self.widths, strict=True))], T.StructType([*kinds, T.StructField("_g", T.IntegerType()), T.StructField("_n", T.IntegerType())]))
        on = F.size("_x") == F.col("_n")
        for i, n in enumerate(names):
            on &= F.col(n).eqNullSafe(F.col(f"_i{i}"))
        self.rows = base.join(F.broadcast(ids), on).select("_g", "_x", "_y", "_f")

    def partial(self, kernel: Kernel, models: list[Model], states: list) -> DataFrame:
        """Sums of ``kernel(x, y, state)`` over the rows of each model, a row for each task; models
        whose state is None are left out."""
        of: dict[int, list[int]] = {}
        for i, m in enumerate(models):
            if states[i] is not None:
                of.setdefault(m.group, []).append(i)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for b in batches:
                g = b.column("_g").to_numpy()
                for group in np.unique(g):
                    mine = of.get(int(group), ())
                    at = np.flatnonzero(g == group) if mine else ()
                    if not len(at):
                        continue
                    width = b.column("_x").value_lengths()[int(at[0])].as_py()
                    for cut in range(0, len(at), step := max(1, AT_ONCE // max(width, 1))):
                        some = b.take(pa.array(at[cut : cut + step]))
                        x = some.column("_x").flatten().to_numpy().reshape(some.num_rows, width)
                        y, f = some.column("_y").to_numpy(), some.column("_f").to_numpy()
                        for i in mine:
                            m = models[i]
                            keep = slice(None) if m.fold is None else f != m.fold
                            one = x[keep] if m.columns is None else x[keep][:, list(m.columns)]
                            v = kernel(one, y[keep], states[i])
                            found[i] = found[i] + v if i in found else v
            task = TaskContext.get().partitionId()
            for i, v in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), _arrays([v])], ["_m", "_t", "v"])

        return self.rows.mapInArrow(run, SUMS)

    def sums(self, kernel: Kernel, models: list[Model], states: list) -> dict[int, np.ndarray]:
        """``partial`` added up in the cluster: the driver gets one array for each model."""
        if self.tasks is None:
            self.tasks = self.rows.rdd.getNumPartitions()
        partial = self.partial(kernel, models, states)
        return {r._m: np.array(r.v) for r in (added(partial, self.tasks) if self.tasks > 1 else partial).collect()}


def added(partial: DataFrame, tasks: int) -> DataFrame:
    """One row for each _m: arrays of over FAN tasks are first added by FAN at a time, in the order of
    the tasks, so that a sum does not depend on which task ends first."""
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        partial = partial.withColumn("_t", F.floor(F.col("_t") / FAN).cast("int")).repartition("_m", "_t").sortWithinPartitions("_m", "_t").mapInArrow(_sum_rows, SUMS)
    return partial.repartition("_m").sortWithinPartitions("_m", "_t").withColumn("_t", F.lit(0)).mapInArrow(_sum_rows, SUMS)


def moments(x: np.ndarray, y: np.ndarray, _: object) -> np.ndarray:
    return np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])


def logistic_sums(x: np.ndarray, y: np.ndarray, state: tuple, square: bool = True) -> np.ndarray:
    """Loss, gradient and, if ``square``, Hessian of the weighted log loss."""
    mu, sd, w, heavy = state
    z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
    m = z @ w
    p, c = 1 / (1 + np.exp(-np.clip(m, -500, 500))), np.where(y > 0.5, heavy[1], heavy[0])
    loss = (c * (np.logaddexp(0, m) - y * m)).sum()
    grad = z.T @ (c * (p - y))
    return np.concatenate([[loss], grad, ((z * (c * p * (1 - p))[:, None]).T @ z).ravel()]) if square else np.concatenate([[loss], grad])


def fit_logistic(
    df: DataFrame,
    by: list[str],
    features: str = "x",
    y: str = "y",
    c: float = 1.0,
    balanced: bool = True,
    scale: bool = True,
    steps: int = 25,
    tolerance: float = 1e-6,
    fold: str | None = None,
    folds: int = 0,
    strengths: dict[str, float] | None = None,
    columns: dict[str, list[int]] | None = None,
) -> DataFrame:
    """L2 logistic regression of each group: columns by, n, n_pos, mu, sigma, weights, bias, steps, converged.

    The objective is w.w / 2 + c * (weighted log loss), the intercept free; ``balanced``
    weighs a class by n / (2 * its rows); ``scale`` standardises by the group's mean and
    population deviation (1 where constant). Groups of one class are left out. ``converged`` is false
    where ``steps`` passes were not enough; the model is then the best so far.

    Several models of a group are fitted from the same readings of its rows: with ``fold`` (a column)
    one for each of ``folds``, without its rows (column ``fold``); with ``strengths`` (name: c) one for
    each (column strength); with ``columns`` (name: indices) one for each choice of features (column
    config, and ``columns`` with the indices).
    """
    g = Groups(df, by, features, y, fold)
    made = [(i, f, s, k) for i in range(len(g.keys)) for f in (range(folds) if fold else [None]) for k in (columns or {None: None}) for s in (strengths or {None: c})]
    models = [Model(i, f, tuple(columns[k]) if columns else None) for i, f, _, k in made]
    power = [(strengths or {None: c})[s] for _, _, s, _ in made]
    width = [len(m.columns) if m.columns is not None else g.widths[m.group] for m in models]
    first = g.sums(moments, models, [()] * len(models)) if models else {}
    state: dict[int, tuple] = {}
    for i, s in first.items():
        n, pos, d = s[0], s[1], width[i]
        if 0 < pos < n:
            mean = s[2 : 2 + d] / n
            sd = np.sqrt(np.maximum(s[2 + d :] / n - mean**2, 0))
            sd = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean)), sd, 1.0)
            heavy = (n / (2 * (n - pos)), n / (2 * pos)) if balanced else (1.0, 1.0)
            state[i] = (mean, sd, heavy) if scale else (np.zeros(d), np.ones(d), heavy)
    square = max(width, default=0) <= MOST_SQUARE and sum((width[i] + 1) ** 2 for i in state) <= MOST_HELD
    fitted = newton(g, models, state, power, steps, tolerance) if square else descend(g, models, state, power, max(steps, 100), tolerance)
    rows, more = [], []
    for i, (w, done, settled) in fitted.items():
        group, f, s, k = made[i]
        extra = [v for v, on in ((k, columns), (list(models[i].columns or ()), columns), (f, fold), (s, strengths)) if on]
        rows.append((*g.keys[group], *extra, int(first[i][0]), int(first[i][1]), state[i][0].tolist(), state[i][1].tolist(), w[:-1].tolist(), float(w[-1]), done, settled))
    more = [n for n, on in (("config string", columns), ("columns array<int>", columns), (f"{fold} int", fold), ("strength string", strengths)) if on]
    return local(df, by, rows, ", ".join([*more, "n long, n_pos long, mu array<double>, sigma array<double>, weights array<double>, bias double, steps int, converged boolean"]))


def local(df: DataFrame, by: list[str], rows: list[tuple], more: str) -> DataFrame:
    spark = df.sparkSession
    fields = [*df.select(*by).schema, *spark.createDataFrame([], more).schema]
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def newton(g: Groups, models: list[Model], state: dict, power: list[float], steps: int, tolerance: float) -> dict[int, tuple[np.ndarray, int, bool]]:
    """Newton steps, halved where the loss rises; all models in the same passes."""
    free = {i: np.append(np.ones(len(s[0])), 0.0) for i, s in state.items()}
    w = {i: np.zeros(len(free[i])) for i in state}
    best = {i: (np.inf, None, None) for i in state}
    open_, took = set(state), dict.fromkeys(state, steps)
    for done in range(1, steps + 1):
        if not open_:
            break
        now = [(state[i][0], state[i][1], w[i], state[i][2]) if i in open_ else None for i in range(len(models))]
        sums = g.sums(logistic_sums, models, now)
        for i in list(open_):
            s, d, c = sums[i], len(free[i]) - 1, power[i]
            loss = c * s[0] + 0.5 * (free[i] * w[i]) @ w[i]
            if loss > best[i][0] + 1e-12 * abs(loss):
                step = best[i][2] / 2
                best[i] = (best[i][0], best[i][1], step)
                w[i] = best[i][1] + step
            else:
                grad = c * s[1 : d + 2] + free[i] * w[i]
                h = c * s[d + 2 :].reshape(d + 1, d + 1) + np.diag(free[i] + 1e-12)
                step = -np.linalg.solve(h, grad)
                best[i] = (loss, w[i].copy(), step)
                w[i] = w[i] + step
            if np.abs(step).max() < tolerance:
                open_.discard(i)
                took[i] = done
    return {i: (best[i][1], took[i], i not in open_) for i in w}


def descend(g: Groups, models: list[Model], state: dict, power: list[float], steps: int, tolerance: float, memory: int = 10) -> dict[int, tuple[np.ndarray, int, bool]]:
    """Limited-memory quasi-Newton steps for wide features; only gradients are summed."""
    free = {i: np.append(np.ones(len(s[0])), 0.0) for i, s in state.items()}
    w = {i: np.zeros(len(free[i])) for i in state}
    best: dict[int, tuple] = {}
    past: dict[int, list] = {i: [] for i in state}
    open_, took = set(state), dict.fromkeys(state, steps)
    for done in range(1, steps + 1):
        if not open_:
            break
        now = [(state[i][0], state[i][1], w[i], state[i][2]) if i in open_ else None for i in range(len(models))]
        sums = g.sums(lambda x, y, s: logistic_sums(x, y, s, False), models, now)
        for i in list(open_):
            loss, grad = power[i] * sums[i][0] + 0.5 * (free[i] * w[i]) @ w[i], power[i] * sums[i][1:] + free[i] * w[i]
            if i in best:
                was, at, slope, step = best[i]
                if loss > was + 1e-4 * (slope @ step):
                    best[i] = (was, at, slope, step / 2)
                    w[i] = at + step / 2
                    if np.abs(step).max() < tolerance:
                        open_.discard(i)
                        took[i] = done
                    continue
                if step @ (grad - slope) > 1e-12:
                    past[i] = [*past[i], (step, grad - slope)][-memory:]
            q, alphas = grad.copy(), []
            for s, t in reversed(past[i]):
                a = (s @ q) / (t @ s)
                alphas.append(a)
                q -= a * t
            q *= (past[i][-1][0] @ past[i][-1][1]) / (past[i][-1][1] @ past[i][-1][1]) if past[i] else 1 / max(1.0, np.abs(grad).max())
            for (s, t), a in zip(past[i], reversed(alphas)):
                q += (a - (t @ q) / (t @ s)) * s
            best[i] = (loss, w[i].copy(), grad, -q)
            if np.abs(grad).max() < tolerance * max(1.0, abs(loss)):
                open_.discard(i)
                took[i] = done
            else:
                w[i] = w[i] - q
    return {i: (best[i][1], took[i], i not in open_) for i in w}


def predict(df: DataFrame, model: DataFrame, by: list[str], features: str = "x", p: str = "p") -> DataFrame:
    """Column ``p``: the model's probability of class 1, null where group or features have none.

    Columns strength and config of the model, where ``fit_logistic`` made them, are kept: a row comes
    once for each. Models of up to ``MOST_SENT`` numbers are broadcast."""
    more = [n for n in ("strength", "config") if n in model.columns and n not in by]
    picked = "columns" in model.columns
    m = model.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *more, F.struct("mu", "sigma", "weights", "bias", *(["columns"] if picked else [])).alias("_m"))
    on = F.lit(True)
    for i, b in enumerate(by):
        on &= F.col(b).eqNullSafe(F.col(f"_k{i}"))
    x = F.col(features).cast("array<double>")
    fits = usable(x) & (F.size(x) > F.array_max("_m.columns") if picked else F.size(x) == F.size("_m.weights"))
    own = F.transform("_m.columns", lambda i: F.get(x, i)) if picked else x
    got = F.when(fits, A.probe(own, F.col("_m.mu"), F.col("_m.sigma"), F.col("_m.weights"), F.col("_m.bias")))
    numbers = model.agg(F.sum(3 * F.size("weights"))).head()[0] or 0
    return df.join(F.broadcast(m) if numbers <= MOST_SENT else m, on, "left").withColumn(p, got).drop("_m", *[f"_k{i}" for i in range(len(by))])


def fit_score(train: DataFrame, test: DataFrame, by: list[str], features: str = "x", y: str = "y", least: int = 0, **fit) -> DataFrame:
    """AUROC on ``test`` of models fitted on ``train``: by, n_train, n, n_pos, auroc.

    Groups with fewer than ``least`` rows of either class in train or test have no value.
    """
    model = fit_logistic(train, by, features, y, **fit)
    out = ranks.auroc(predict(test, model, by, features), by, "p", y)
    trained = model.select(*by, F.col("n").alias("n_train"), F.least(F.col("n_pos"), F.col("n") - F.col("n_pos")).alias("_few"))
    out = ranks.guarded(out, least).join(F.broadcast(trained), by, "left") if by else ranks.guarded(out, least).join(F.broadcast(trained), F.lit(True), "left")
    return out.withColumn("auroc", F.when(F.col("_few") >= least, F.col("auroc"))).drop("_few")


def out_of_fold(df: DataFrame, by: list[str], key: str, features: str = "x", y: str = "y", folds: int = 5, seed: str = "42", **fit) -> DataFrame:
    """``df`` with fold and the probability ``p`` of a model that has not seen the row's fold. The
    models of all folds are fitted from one reading of the rows in each pass."""
    cut = rel.stratified_folds(df, [*by, y], key, folds, seed)
    return predict(cut, fit_logistic(cut, by, features, y, fold="fold", folds=folds, **fit), [*by, "fold"], features)


def cross_validate(df: DataFrame, by: list[str], key: str, features: str = "x", y: str = "y", folds: int = 5, seed: str = "42", **fit) -> DataFrame:
    """Mean held-out AUROC over the folds: by (and config, strength where they are fitted), auroc."""
    told = out_of_fold(df, by, key, features, y, folds, seed, **fit)
    keys = [*by, *[n for n, on in (("config", fit.get("columns")), ("strength", fit.get("strengths"))) if on]]
    return ranks.auroc(told, [*keys, "fold"], "p", y).groupBy(*keys).agg(F.avg("auroc").alias("auroc"))


def _best(got: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    ordered = got.withColumn("ord", F.array_position(F.array(*map(F.lit, names)), F.col("config")).cast("int") - 1)
    return rel.argmax(ordered, by, "auroc", "ord", ["config", "ord", "auroc"])


def select_config(df: DataFrame, by: list[str], key: str, configs: list[tuple[str, Column]], y: str = "y", **fit) -> DataFrame:
    """The configuration of best cross-validated AUROC, the earlier of equals: by, config, ord, auroc."""
    from verisieve.operators.detectors import combinations

    names = [name for name, _ in configs]
    long = combinations(df.select(*dict.fromkeys([*by, key, y]), *[x.alias(f"_x{i}") for i, (_, x) in enumerate(configs)]), {n: F.col(f"_x{i}") for i, n in enumerate(names)}, {n: (n,) for n in names})
    return _best(cross_validate(long.select(*by, key, y, F.col("combo").alias("config"), "x"), [*by, "config"], key, "x", y, **fit), by, names)


def select_columns(df: DataFrame, by: list[str], key: str, columns: dict[str, list[int]], features: str = "x", y: str = "y", **fit) -> DataFrame:
    """``select_config`` where every configuration is a choice of components of one feature array (as
    a smaller k is of a larger one, head by head): the array is read once in each pass for all."""
    return _best(cross_validate(df, by, key, features, y, columns=columns, **fit), by, list(columns))


def first_of_each(blocks: int, width: int, k: int) -> list[int]:
    """Indices of the first ``k`` of each of ``blocks`` stretches of ``width`` components."""
    return [b * width + i for b in range(blocks) for i in range(min(k, width))]
