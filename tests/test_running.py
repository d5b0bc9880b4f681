"""Running totals of groups that span many tasks, against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import frames, ranks
from verisieve.operators import relational as rel
from verisieve.operators.running import running


@pytest.mark.parametrize("reverse", [False, True])
def test_running_totals(spark, reverse):
    r = np.random.default_rng(1)
    rows = [(g, float(v), int(i), int(r.integers(9))) for i, (g, v) in enumerate(zip(r.choice([0, 0, 0, 0, 1, None], 900).tolist(), r.integers(0, 40, 900)))]
    df = spark.createDataFrame(rows, "g int, v double, i int, n int").repartition(7)
    got = {x.i: (x.s, x.m) for x in running(df, ["g"], ["v", "i"], {"s": "n"}, {"m": "n"}, reverse=reverse, rows=len(rows), range_rows=90).collect()}
    for g in (0, 1, None):
        mine = sorted([x for x in rows if x[0] == g], key=lambda x: x[1:3], reverse=reverse)
        total, least = 0, 99
        for _, _, i, n in mine:
            total, least = total + n, min(least, n)
            assert got[i] == (total, least)
    assert running(df, [], ["v", "i"], {"s": "n"}).agg(F.max("s")).first()[0] == sum(x[3] for x in rows)
    assert running(df.where("false"), ["g"], ["v"], {"s": "n"}).count() == 0


def test_one_group_spans_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 7 % 20_000).cast("double").alias("score"), (F.col("id") % 2).alias("y"))
    laid = running(df.withColumn("one", F.lit(1)), ["g"], ["score"], {"k": "one"}, wholes={"n": "one"}, rows=20_000, range_rows=1000)
    assert [(r.score, r.k, r.n) for r in laid.orderBy("score").collect()] == [(float(i), i + 1, 20_000) for i in range(20_000)]
    assert len(set(laid.inputFiles())) > 10
    x = np.arange(20_000) * 7 % 20_000
    y = np.arange(20_000) % 2
    want = (x[y == 1][:, None] > x[y == 0][None, ::10]).mean()
    assert abs(ranks.auroc(df, ["g"]).first().auroc - want) < 1e-3


def counted(spark, make):
    """The result of ``make`` (of a table) and how often the table's rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("ab"[i % 2], float(i * 37 % 91), i, int(i * 7 % 10 < 4), i / 700) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, score double, id long, y int, p double").mapInArrow(note, "g string, score double, id long, y int, p double")
    out = make(df).collect()
    return rows, out, seen.value / len(rows)


@pytest.mark.parametrize(
    "make",
    [
        lambda df: ranks.auroc(df, ["g"]),
        lambda df: ranks.average_precision(df, ["g"], "score", "y"),
        lambda df: ranks.mann_whitney(df, ["g"]),
        lambda df: ranks.auarc(df, ["g"], "score", "y", "id"),
        lambda df: ranks.benjamini_hochberg(df, ["g"], "p", "id"),
        lambda df: rel.stratified_split(df, ["g", "y"], "id", 0.3, "7"),
        lambda df: frames.shard(df, ["id"], 1, 3),
    ],
)
def test_input_is_evaluated_twice_at_most(spark, make):
    assert counted(spark, make)[2] <= 2


def test_one_layout_serves_several_statistics(spark):
    def make(df):
        laid = ranks.Layout(df, ["g"])
        return laid.auroc().join(laid.average_precision(), "g").join(laid.mann_whitney().drop("n", "n_pos"), "g")

    rows, got, times = counted(spark, make)
    assert times == 1
    for r in got:
        mine = [(s, y) for g, s, _, y, _ in rows if g == r.g]
        pos, neg = [s for s, y in mine if y], [s for s, y in mine if not y]
        u = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        at = lambda s: (sum(y for t, y in mine if t >= s), sum(t >= s for t, _ in mine))
        assert r.n == len(mine) and r.n_pos == len(pos) and abs(r.auroc - u / len(pos) / len(neg)) < 1e-12 and r.u == u
        assert abs(r.average_precision - sum(a / b for a, b in map(at, pos)) / len(pos)) < 1e-12


def test_groups_of_odd_keys(spark):
    nan = float("nan")
    rows = [(k, s, i, None if i % 5 == 0 else float(i)) for i, (k, s) in enumerate([(nan, "a"), (None, "a"), (0.0, None), (-0.0, None), (nan, "b")] * 40)]
    df = spark.createDataFrame(rows, "k double, s string, i long, v double").withColumn("pair", F.struct(F.abs("k").alias("k"), "s"))
    for by in (["k", "s"], ["pair"]):
        got = {r.i: (r.t, r.m, r.w) for r in running(df, by, ["i"], {"t": "v"}, {"m": "v"}, {"w": "v"}, rows=200, range_rows=13).collect()}
        key = lambda r: (str(r[0]).lstrip("-"), r[1])
        for k in {key(r) for r in rows}:
            mine = [r for r in rows if key(r) == k]
            total, least = 0.0, None
            for r in mine:
                total += r[3] or 0
                least = r[3] if least is None else least if r[3] is None else min(least, r[3])
                assert got[r[2]] == (total, least, sum(x[3] or 0 for x in mine))


def test_discoveries(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.2), ("b", 0.05)], "k string, q double")
    assert {(r.k, r.n, r.below, r.share) for r in ranks.discoveries(df, ["k"]).collect()} == {("a", 2, 1, 0.5), ("b", 1, 0, 0.0)}
