"""Answer measures, rank tests, sources and sinks against plain code."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import features
from verisieve.operators import generations as gen
from verisieve.sources import readers, sinks


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in "12")
        assert gen.longest_common(a, b) == lcs(a, b)


def test_lexical_similarity(spark):
    rows = [(1, 0, "the cat sat"), (1, 1, "The cat, slept!"), (1, 2, None), (2, 0, "alone")]
    got = {r.k: r.lexical_similarity for r in gen.lexical_similarity(gen.first_answers(spark.createDataFrame(rows, "k int, t int, text string"), "k", "t"), "k", "text").collect()}
    assert set(got) == {1} and abs(got[1] + (2 * 2 / 6) / 3) < 1e-9


def test_clusters_and_spectrum(spark):
    same = {(0, 2), (2, 0), (1, 2), (2, 1), (3, 1), (1, 4), (4, 1)} | {(i, i) for i in range(5)}
    pairs = spark.createDataFrame([(1, i, j, (i, j) in same, 1.0 if i == j else 0.0) for i in range(5) for j in range(5)], "k int, i int, j int, same boolean, sim double")
    got = {r.i: r.cluster for r in gen.semantic_clusters(pairs, "k", "same").collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 1}
    want = math.log(5) - 2 * 2 * math.log(2) / 5
    assert abs(gen.cluster_entropy(gen.semantic_clusters(pairs, "k", "same"), "k").first().entropy - want) < 1e-9
    r = gen.spectral_measures(pairs, "k", "sim").first()
    assert abs(r.sum_eigv - 5) < 1e-9  # five unlike answers
    ones = gen.spectral_measures(pairs.withColumn("sim", F.lit(1.0)), "k", "sim").first()
    assert abs(ones.sum_eigv - 1) < 1e-9 and abs(ones.eccentricity) < 1e-9


def test_memo_asks_once(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "b", None)], "k int, a string, b string")
    got = {r.k: r.sim for r in gen.memo_pairs(pairs, lambda a, b: a.str.len() + b.fillna("").str.len()).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 1.0}


@pytest.mark.parametrize("m, k", [(2, 3), (4, 4), (3, 6)])
def test_exact_rank_sum(spark, m, k):
    r = np.random.default_rng(m)
    s = r.permutation(m + k).astype(float)
    y = [1] * m + [0] * k
    us = [sum(1 for a in c for b in set(range(m + k)) - set(c) if a > b) for c in itertools.combinations(range(m + k), m)]
    got = features.rank_sum_test(spark.createDataFrame([("c", float(v), t) for v, t in zip(s, y)], "g string, score double, y int"), ["g"]).first()
    u = sum(1 for a in s[:m] for b in s[m:] if a > b)
    assert got.u == u
    assert abs(got.p - min(1, 2 * np.mean([v >= max(u, m * k - u) for v in us]))) < 1e-12


def test_equal_scores_have_p_one(spark):
    assert features.rank_sum_test(spark.createDataFrame([("c", 1.0, t) for t in (0, 1, 0, 1)], "g string, score double, y int"), ["g"]).first().p == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text(json.dumps({"a": {"responses": [" x ", "", "y"]}, "b": {"responses": ["only"]}, "c": {"responses": [str(i) for i in range(12)]}}))
    assert {r.id: list(r.answers) for r in readers.read_generations(spark, str(tmp_path / "g.jsonl")).collect()} == {"a": ["x", "y"], "c": [str(i) for i in range(10)]}
    (tmp_path / "ids.json").write_text(json.dumps(["train::4", "validation::11"]))
    assert [tuple(r) for r in readers.read_split(spark, str(tmp_path / "ids.json")).collect()] == [("train::4", "train", 4), ("validation::11", "validation", 11)]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"id": "1", "candidate": "c", "s_ext": s}) for s in (1.0, 2.0)))
    assert [r.s_ext for r in readers.read_records(spark, str(tmp_path / "r.jsonl")).collect()] == [2.0]
    assert readers.read_jsonl(spark, str(tmp_path / "absent")).count() == 0
    with pytest.raises(ValueError):
        readers.parse_samples(spark.createDataFrame([("1",)], "id string"))
    with pytest.raises(Exception):
        readers.lookup(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 0, 5)], "k int, o int, v int"), ["k"], "o", strict=True).collect()


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.5, "x"), (2, None, 'q"\n,')], "k int, v double, t string")
    sinks.write_csv(a, str(tmp_path / "c"), ["k", "t", "v", "more"], 4)
    assert sorted((r.k, r.v, r.t, r.more) for r in readers.read_csv(spark, str(tmp_path / "c")).collect()) == [("1", "0.5000", "x", None), ("2", None, 'q"\n,', None)]
    built = []
    for _ in range(2):
        sinks.materialise(spark, str(tmp_path / "m"), lambda: built.append(1) or a)
    assert built == [1]
    assert sinks.promote(a, str(tmp_path / "p"), a, ["k"]) is None
    with pytest.raises(ValueError):
        sinks.promote(a.where("k = 1"), str(tmp_path / "p"), a, ["k"])
    assert sinks.read_current(spark, str(tmp_path / "p")).count() == 2
    assert spark.read.parquet(sinks.promote(a, str(tmp_path / "p"), a, ["k"])).count() == 2
    assert sinks.markdown(a, "T", ["k", "v"]).splitlines()[4:] == ["| 1 | 0.5000 |", "| 2 | — |"]
