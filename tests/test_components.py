"""Components of features of any width, and tables that are joined without moving them."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import components, matching
from verisieve.sources import buckets


def low_rank(n, d, seed, rank=6):
    r = np.random.default_rng(seed)
    return r.standard_normal((n, rank)) * 2.0 ** -np.arange(rank) @ r.standard_normal((rank, d)) + 1e-3 * r.standard_normal((n, d)) + 5


def plain(x, k):
    values, vectors = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
    return values[:k] ** 2 / len(x), vectors[:k]


def put_together(got, g):
    mine = sorted((r for r in got if r.g == g), key=lambda r: r.block)
    return mine[0].variance, np.concatenate([r.mu for r in mine]), np.concatenate([np.array(r.components) for r in mine], axis=1)


def agrees(got, g, x, k):
    variance, mu, axes = put_together(got, g)
    want, vectors = plain(x, k)
    assert np.allclose(mu, x.mean(0)) and np.allclose(variance, want, rtol=1e-6)
    assert np.allclose(np.abs(axes @ vectors.T), np.eye(k), atol=1e-4) and np.allclose(axes @ axes.T, np.eye(k), atol=1e-8)
    assert all(axis[np.abs(axis).argmax()] > 0 for axis in axes)
    return axes, mu


@pytest.mark.parametrize("block, stripe", [(1024, 1 << 22), (7, 1 << 22), (7, 200)])
def test_components_in_one_block_or_many(spark, monkeypatch, block, stripe):
    monkeypatch.setattr(components, "STRIPE", stripe)
    monkeypatch.setattr(components, "TILE", 500)
    monkeypatch.setattr(components, "FAN", 2)
    monkeypatch.setattr(components, "BUCKETS", 4)
    monkeypatch.setattr(components, "BUCKET", 100)
    x = {1: low_rank(150, 30, 1), None: low_rank(90, 17, 2)}
    rows = [(g, i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)] + [(1, 900, None), (1, 901, [1.0]), (1, 902, [float("nan")] * 30), (5, 903, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "g int, id long, x array<double>").repartition(3)
    model = components.fit_components(df, ["g"], 4, rounds=6, block=block)
    got = model.where("g IS NULL OR g = 1").collect()
    z = {(r.g, r.id): r.z for r in components.project(df, model, ["g"], "x", "z").collect()}
    assert len(z) == len(rows) and z[1, 900] is None and z[1, 901] is None and z[1, 902] is None
    for g, m in x.items():
        axes, mu = agrees(got, g, m, 4)
        assert np.allclose([z[g, i] for i in range(len(m))], (m - mu) @ axes.T)


def test_wide_features_stay_in_blocks(spark, monkeypatch):
    d, k = 20_000, 5
    monkeypatch.setattr(components, "STRIPE", 60_000)  # of 300,000 numbers of a basis
    monkeypatch.setattr(components, "BUCKET", 1 << 18)
    x = low_rank(60, d, 3)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, x array<double>").repartition(4)
    df.count()
    tracemalloc.start()
    model = components.fit_components(df, ["g"], k, rounds=3)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 8 * d * (k + 10) * 2  # a stripe as Python numbers and arrays, never the basis
    agrees(model.collect(), 1, x, k)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0, 4.0]), (1, 2, [2.0, 2.0, 4.0]), (2, 3, [1.0, 1.0, 1.0])], "g int, id long, x array<double>")
    got = {r.g: r for r in components.fit_components(df, ["g"], 9).collect()}
    assert np.allclose(np.abs(got[1].components), [[1, 0, 0]]) and np.allclose(got[1].variance, [0.25])
    assert np.allclose(got[2].variance, 0)
    assert components.fit_components(df.where("false"), ["g"]).count() == 0


def test_states_in_buckets_are_joined_where_they_are(spark, tmp_path):
    states = spark.range(300).select((F.col("id") % 100).alias("id"), F.concat(F.lit("c"), F.col("id") % 3).alias("candidate"), (F.col("id") % 4).cast("int").alias("layer"), F.array(F.col("id") * 1.0).alias("vector"))
    keys = spark.createDataFrame([(i, "c" + str(i % 3)) for i in range(0, 100, 3)], "id long, candidate string")
    buckets.write_bucketed(states, f"{tmp_path}/states", ["id", "candidate"], 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        there = buckets.open_bucketed(spark, f"{tmp_path}/states", ["id", "candidate"], 8)
        held = matching.layer_states(keys, there, [0], ["id", "candidate"])
        moved = matching.layer_states(keys, states, [0], ["id", "candidate"])
        plan = held._jdf.queryExecution().executedPlan().toString()
        over = plan.split("FileScan")[0]
        assert "Bucketed: true" in plan and sorted(map(tuple, held.collect())) == sorted(map(tuple, moved.collect()))
        lines = plan.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
        depth = lines[scan].index("FileScan")
        for line in reversed(lines[:scan]):  # up from the scan, along its ancestors
            at = len(line) - len(line.lstrip(" :+-"))
            if at < depth:
                depth = at
                assert "Exchange" not in line
        assert over
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
