"""Fitted models against plain numpy on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import models


def data(n=400, d=6, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) * np.arange(1, d + 1) + 2
    y = (x @ r.standard_normal(d) + 2 * r.standard_normal(n) > 3).astype(int)
    return x, y


def plain_fit(x, y, c=1.0, scale=True):
    mu, sd = (x.mean(0), x.std(0)) if scale else (0, 1)
    z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
    s = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    free, w = np.append(np.ones(x.shape[1]), 0), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(c * (z * (s * p * (1 - p))[:, None]).T @ z + np.diag(free), c * z.T @ (s * (p - y)) + free * w)
    return w


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for g in (0, 1, None):
        x, y = data(seed=g or 9)
        out += [(g, i, x[i].tolist(), int(y[i])) for i in range(len(x))]
    out += [(0, 900, None, 1), (0, 901, [1.0], 0), (0, 902, [float("nan")] * 6, 1), (0, 903, [0.0] * 6, None), (7, 904, [1.0] * 6, 1)]
    return spark.createDataFrame(out, "g int, id long, x array<double>, y int").repartition(5)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("c, scale", [(1.0, True), (0.1, False)])
def test_logistic(rows, c, scale, wide, monkeypatch):
    if wide:
        monkeypatch.setattr(models, "MOST_SQUARE", 2)
    got = {r.g: r for r in models.fit_logistic(rows, ["g"], c=c, scale=scale).collect()}
    assert set(got) == {0, 1, None}
    for g, r in got.items():
        x, y = data(seed=g or 9)
        assert np.allclose([*r.weights, r.bias], plain_fit(x, y, c, scale), atol=2e-3) and r.n == 400


def test_predict_leaves_unusable_rows_empty(rows):
    p = {r.id: r.p for r in models.predict(rows, models.fit_logistic(rows, ["g"]), ["g"]).where("g = 0 OR g = 7").collect()}
    assert p[900] is None and p[901] is None and p[902] is None and p[904] is None and 0 < p[903] < 1


def test_held_out_scores(rows):
    out = models.out_of_fold(rows.where("id < 900"), ["g"], "id")
    assert out.where("p IS NULL").count() == 0
    cv = models.cross_validate(rows.where("id < 900 AND g IS NOT NULL"), ["g"], "id").collect()
    assert len(cv) == 2 and all(0.7 < r.auroc < 1 for r in cv)
    best = models.select_config(rows.where("id < 900 AND g = 0"), ["g"], "id", [("first", F.slice("x", 1, 1)), ("all", F.col("x")), ("again", F.col("x"))]).first()
    assert best.config == "all"


def test_nothing_to_fit(spark):
    none = spark.createDataFrame([], "g int, id long, x array<double>, y int")
    assert models.fit_logistic(none, ["g"]).count() == 0


@pytest.mark.parametrize("tasks", [1, 40, 4000])
def test_the_driver_gets_one_array_for_each_model(spark, tasks):
    partial = spark.range(tasks * 3).selectExpr("CAST(id % 3 AS INT) AS _m", "CAST(id DIV 3 AS INT) AS _t", "array(1D, CAST(id DIV 3 AS DOUBLE)) AS v").repartition(7)
    got = models.added(partial, tasks).collect()
    assert sorted((r._m, r.v) for r in got) == [(m, [tasks, tasks * (tasks - 1) / 2]) for m in range(3)]


def test_models_that_share_rows_equal_those_fitted_alone(rows):
    mine = rows.where("id < 900 AND g IS NOT NULL").withColumn("part", (F.col("id") % 3).cast("int"))
    both = models.fit_logistic(mine, ["g"], fold="part", folds=3, strengths={"weak": 0.01, "full": 1.0}, columns={"two": [4, 1], "all": list(range(6))}).collect()
    assert len(both) == 2 * 3 * 2 * 2 and all(r.converged and r.steps < 25 for r in both)
    for r in both:
        x, y = data(seed=r.g or 9)
        keep = np.arange(len(x)) % 3 != r.part
        want = plain_fit(x[keep][:, list(r.columns)], y[keep], {"weak": 0.01, "full": 1.0}[r.strength])
        assert np.allclose([*r.weights, r.bias], want, atol=2e-3) and r.n == keep.sum()


def test_fits_that_do_not_settle_say_so(rows):
    got = models.fit_logistic(rows.where("id < 900"), ["g"], steps=2).collect()
    assert got and not any(r.converged for r in got) and {r.steps for r in got} == {2}


def test_columns_are_chosen_as_configurations_are(rows):
    mine = rows.where("id < 900 AND g = 0")
    grid = {"k=1": models.first_of_each(2, 3, 1), "k=2": models.first_of_each(2, 3, 2), "k=3": models.first_of_each(2, 3, 9)}
    assert grid["k=2"] == [0, 1, 3, 4] and grid["k=3"] == list(range(6))
    picked = models.select_columns(mine, ["g"], "id", grid).first()
    plain = models.select_config(mine, ["g"], "id", [(n, F.array(*[F.col("x")[i] for i in c])) for n, c in grid.items()]).first()
    assert picked.config == plain.config and picked.ord == plain.ord and abs(picked.auroc - plain.auroc) < 1e-9


def test_wide_models_are_joined_by_shuffle(rows, monkeypatch):
    model = models.fit_logistic(rows.where("id < 900"), ["g"])
    sent = {(r.g, r.id): r.p for r in models.predict(rows, model, ["g"]).collect()}
    monkeypatch.setattr(models, "MOST_SENT", 0)
    assert {(r.g, r.id): r.p for r in models.predict(rows, model, ["g"]).collect()} == sent
