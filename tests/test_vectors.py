"""Vector aggregates against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.functions import arrays as A
from verisieve.operators import frames, vectors
from verisieve.plans import registry


def test_statistics_equal_plain_ones(spark):
    r = np.random.default_rng(4)
    nan = float("nan")
    keys = [("a", 1.0), ("a", None), (None, 1.0), ("b", nan)]
    rows = [(*keys[i % 3 if i % 7 else 3], [None if r.random() < 0.1 else float(v) for v in 1e6 + r.standard_normal(5 - i % 2)]) for i in range(9000)]
    rows += [("gone", 0.0, None), ("bare", 0.0, []), ("nulls", 0.0, [None, None])]
    df = spark.createDataFrame(rows, "s string, k double, v array<double>").repartition(6)
    key = lambda s, k: (s, "nan" if k is not None and math.isnan(k) else k)
    got = {key(x.s, x.k): x for x in vectors.mean_and_deviation(df, ["s", "k"], "v", 0.5).collect()}
    assert set(got) == {key(*k) for k in keys} | {("bare", 0.0), ("nulls", 0.0)}
    for k, x in got.items():
        mine = [v for s, d, v in rows if key(s, d) == k]
        for i in range(max(map(len, mine))):
            seen = [v[i] for v in mine if len(v) > i and v[i] is not None]
            if seen:
                assert abs(x.mu[i] - np.mean(seen)) < 1e-6 and abs(x.sigma[i] - np.std(seen) - 0.5) < 1e-6
            else:
                assert x.mu[i] is None and x.sigma[i] is None
    whole = vectors.vector_stats(df, [], "v").first()
    assert whole.n[0] == sum(len(v) > 0 and v[0] is not None for *_, v in rows if v is not None)
    assert vectors.vector_stats(df.where("false"), ["s"], "v").collect() == []


def test_no_vector_becomes_rows(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("g"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("v"))
    for out in (frames.vector_mean(df, ["g"], "v"), vectors.mean_and_deviation(df, ["g"], "v"), frames.sanity(df, ["g"], "v")):
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_sanity_of_odd_values(spark):
    rows = [(1, [1.0, float("nan"), 3.0]), (1, [None]), (1, []), (1, None), (2, [5.0, 5.0]), (3, [float("inf")]), (4, [])]
    got = {x.g: x for x in frames.sanity(spark.createDataFrame(rows, "g int, v array<double>"), ["g"], "v").collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].finite, got[1].least, got[1].most, got[1].mean, got[1].deviation) == (False, 1.0, 3.0, 2.0, 1.0)
    assert got[2].finite and got[2].constant and got[2].deviation == 0
    assert not got[3].finite and got[3].mean is None


def test_what_is_rounded_to_zero_keeps_its_sign(spark):
    values = [-1e-7, 1e-7, -0.0, 0.0, -0.0000005, 1.2345675, -2.5e-6, float("nan"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(A.rounded(F.col("v"), 6)).collect()]
    assert [repr(x) for x in got] == ["-0.0", "0.0", "-0.0", "0.0", "-1e-06", "1.234568", "-3e-06", "nan", "-inf", "None"]


def test_array_queries_keep_the_sign_of_zero_as_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.choice([-1e-7, 1e-7, -0.25, 0.5], 64)], i % 3) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("attention_diagonal", "attention_pass", "spectral_features", "late_vector_mean", "topk_values"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        found = con.execute(registry.ORACLES[name]).fetchall()
        names = [d[0] for d in con.description]
        told = sorted(repr([r[c] for c in names]) for r in got.collect())
        assert told == sorted(repr(list(x)) for x in found) and (name == "topk_values" or "-0.0" in str(told))
