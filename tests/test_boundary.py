"""Batches by tokens, outputs as arrays, and model scores that outlive a run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verisieve.operators import boundary
from verisieve.operators import generations as gen


def test_batches_hold_their_budget_and_pad_less():
    sizes = np.random.default_rng(2).lognormal(4, 1, 5000).astype(int)
    got = boundary.token_batches(sizes, 8192)
    assert sorted(np.concatenate(got)) == list(range(5000))
    assert all(len(b) * sizes[b].max() <= 8192 or len(b) == 1 for b in got)
    before = [np.arange(at, min(at + 32, 5000)) for at in range(0, 5000, 32)]
    assert boundary.padded_share(sizes, before) > 0.6 and boundary.padded_share(sizes, got) < 0.05
    assert boundary.token_batches(np.array([], int), 10) == [] and [len(b) for b in boundary.token_batches(np.array([0, 0, 99]), 10)] == [2, 1]


def models():
    """Stand-ins by output; made in a function, so that workers get them by value."""
    return {
        "states": lambda name: lambda rows: [{n: np.full(3, len(text) + n, np.float32) for n in (1, 2)} for (text,) in rows],
        "attention": lambda name: lambda rows: [np.arange(2 * 2 * len(t) * len(t), dtype=float).reshape(2, 2, len(t), len(t)) for (t,) in rows],
        "values": lambda name: lambda rows: [{"layers.10": np.ones((len(t), 4)), "layers.2": 2 * np.ones((len(t), 4)), "vision.0": np.ones((1, 4))} for (t,) in rows],
        "sidecar": lambda name: lambda rows: [(np.ones((2, len(t))) if t != "ab" else [], {5: 0.5, 7: float(len(t))}) for (t,) in rows],
    }


@pytest.mark.parametrize("tokens", [None, "n"])
def test_results_do_not_depend_on_batches(spark, tokens):
    texts = ["ab", "abcd", "a", "abc"] * 10
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "id long, t string, n int").repartition(3)
    given = {"tokens": tokens, "budget": 9, "batch": 4}
    h = boundary.hidden_states(df, ["id"], ["t"], "h", models()["states"], [1, 2], **given).collect()
    assert sorted((r.id, r.layer, tuple(r.vector)) for r in h) == sorted((i, n, (len(t) + n,) * 3) for i, t in enumerate(texts) for n in (1.0, 2.0))
    a = {(r.id, r.layer, r.head): r for r in boundary.attention_diagonals(df, ["id"], ["t"], "a", models()["attention"], **given).collect()}
    assert len(a) == 4 * len(texts)
    for i, t in enumerate(texts):
        m = np.arange(4 * len(t) ** 2, dtype=float).reshape(2, 2, len(t), len(t))[1, 0]
        assert a[i, 1, 0].attn_diag == np.diagonal(m).tolist()
        assert np.allclose(a[i, 1, 0].lap_diag, m.sum(0) / (len(t) - np.arange(len(t))) - np.diagonal(m))
    v = boundary.value_norms(df, ["id"], ["t"], "v", models()["values"], 2, **given).collect()
    assert len(v) == 4 * len(texts) and all(np.allclose(r.vnorm, [2 * 2**0.5 if r.layer == 0 else 2**0.5] * len(texts[r.id])) for r in v)
    s = {r.id: r for r in boundary.answer_sidecars(df, ["id"], ["t"], "s", models()["sidecar"], **given).collect()}
    assert set(s) == {i for i, t in enumerate(texts) if t != "ab"}
    assert all(r.s_ext_l == {0: 1.0, 1: 1.0} and r.s_int == {5: 0.5, 7: float(len(texts[i]))} and r.n_answer_tokens == len(texts[i]) for i, r in s.items())


def test_a_model_that_lacks_a_layer_is_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    with pytest.raises(Exception, match="lacking"):
        boundary.hidden_states(df, ["id"], ["t"], "h", models()["states"], [1, 9]).collect()


def test_the_second_run_asks_the_model_nothing(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([[0.0, 1.0, float(len(x) + len(y))] for x, y in zip(a, b)])

    rows = [(q, i, f"question {q}", ["yes", "no", "yes"][i]) for q in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "q long, i int, question string, answer string")
    memo = str(tmp_path / "memo")
    first = sorted(map(tuple, gen.entailment_pairs(df, "q", "question", "answer", model, memo).collect()))
    assert asked.value == 6 * 4  # two texts a question
    again = sorted(map(tuple, gen.entailment_pairs(df, "q", "question", "answer", model, memo).collect()))
    assert asked.value == 6 * 4 and first == again
    assert sorted(map(tuple, gen.entailment_pairs(df, "q", "question", "answer", model).collect())) == first
    more = df.unionByName(spark.createDataFrame([(9, 0, "new", "a"), (9, 1, "new", "b")], df.schema))
    before = asked.value
    assert gen.entailment_pairs(more, "q", "question", "answer", model, memo).count() == 6 * 9 + 4 and asked.value == before + 4


def test_records_of_questions(spark):
    model = lambda a, b: pd.Series([[0.0, 0.0, 5.0] if x == y else [5.0, 0.0, 0.0] for x, y in zip(a, b)])
    df = spark.createDataFrame([(1, 0, "q", "same"), (1, 1, "q", "same"), (2, 0, "q", "left"), (2, 1, "q", "right"), (3, 0, "q", "alone")], "q long, i int, question string, answer string")
    got = {r.q: r for r in gen.uncertainty_records(df, "q", "question", "answer", model).collect()}
    assert set(got) == {1, 2} and tuple(got[1].asDict())[1:] == gen.MEASURES
    assert got[1].num_set == 1 and got[2].num_set == 2 and got[1].luq < got[2].luq and got[1].snne < got[2].snne
    assert got[1].lexical_sim == -1 and got[2].lexical_sim == -0.5  # the question is part of the text
    told = spark.createDataFrame([(i, i % 2, float(i), True) for i in range(8)], "q long, pair int, luq double, right boolean").withColumn("right", F.col("q") < 4)
    table = {(r.pair, r.method): r for r in gen.measure_table(told, ["pair"], "q", "right", ("luq",)).collect()}
    assert table[0, "luq"].auroc == 1 and table[1, "luq"].aucpr == 1 and table[0, "luq"].n == 4 and abs(table[0, "luq"].auarc - (1 + 1 + 2 / 3 + 0.5) / 4) < 1e-12
