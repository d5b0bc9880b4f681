"""Detectors and their parts against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import plain_fit

from verisieve.functions import arrays as A
from verisieve.operators import boundary, detectors, features, frames, matching, models
from verisieve.operators import relational as rel
from verisieve.operators import generations as gen
from verisieve.sources import readers, sinks
from verisieve.sources.tables import shared_folder


def test_combinations_are_fitted_as_by_themselves(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 5))
    y = (x[:, 0] + x[:, 3] + 0.5 * r.standard_normal(300) > 0).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id long, e array<double>, y int")
    blocks, combos = {"a": F.slice("e", 1, 2), "b": F.slice("e", 3, 3)}, {"a": ("a",), "b": ("b",), "b+a": ("b", "a")}
    long = detectors.combinations(df, blocks, combos)
    got = {m.combo: [*m.weights, m.bias] for m in models.fit_logistic(long, ["combo"]).collect()}
    for name, cols in (("a", [0, 1]), ("b", [2, 3, 4]), ("b+a", [2, 3, 4, 0, 1])):
        assert np.allclose(got[name], plain_fit(x[:, cols], y), atol=2e-3)
    best = detectors.best_measure(df.select("y", *[F.col("e")[i].alias(f"m{i}") for i in range(5)]).withColumn("g", F.lit(1)), ["g"], [f"m{i}" for i in range(5)]).first()
    wins = [(x[y == 1][:, i][:, None] > x[y == 0][:, i]).mean() for i in range(5)]
    assert best.measure == f"m{int(np.argmax(wins))}"


def test_hidden_probe_against_plain_code(spark):
    r = np.random.default_rng(9)
    n, layers, width = 200, 4, 3
    v = r.standard_normal((n, layers, width)) * 2 + 1
    y = (v[:, 1, 0] + v[:, 2, 1] + r.standard_normal(n) > 2).astype(int)
    lp = r.standard_normal(n)
    states = spark.createDataFrame([("p", i, k, v[i, k].tolist(), float(lp[i])) for i in range(n) for k in range(layers) if (i, k) != (7, 2)], "pair string, id long, layer int, vector array<double>, log_prob double")
    rows = spark.createDataFrame([("p", i, int(y[i])) for i in range(n)], "pair string, id long, y int")
    got = {x.id: x.p for x in detectors.hidden_probe(rows.where("id < 150"), rows.where("id >= 150"), states, {"one": {"mid": [0, 1], "late": [2, 3]}}, ["pair"], ["id"], {"default": 1.0}).collect()}
    ok = [i for i in range(150) if i != 7]
    mu = np.array([[v[[i for i in range(150) if (i, k) != (7, 2)], k].mean(0)] for k in range(layers)])[:, 0]
    sd = np.array([[v[[i for i in range(150) if (i, k) != (7, 2)], k].std(0) + 1e-6] for k in range(layers)])[:, 0]
    z = (v - mu) / sd
    x = np.column_stack([z[:, :2].mean(1), z[:, 2:].mean(1), lp])
    w = plain_fit(x[ok], y[ok])
    m, s = x[ok].mean(0), x[ok].std(0)
    want = 1 / (1 + np.exp(-(((x - m) / s) @ w[:-1] + w[-1])))
    assert set(got) == set(range(150, n)) and np.allclose([got[i] for i in range(150, n)], want[150:], atol=2e-3)


def test_answer_classifier_needs_training_rows_or_folds(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((160, 2))
    y = (x[:, 0] > 0.1 * r.standard_normal(160)).astype(int)
    df = spark.createDataFrame([(i % 2, i, float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(160)], "g int, id long, f1 double, f2 double, y int")
    train = df.where("g = 0 AND id < 80")
    got = {a.id: (a.g, a.p) for a in detectors.answer_classifier(df.where("id >= 80 OR g = 1"), ["g"], "id", train, features=("f1", "f2")).collect()}
    assert set(got) == {i for i in range(160) if i >= 80 or i % 2}
    assert all((p > 0.5) == bool(y[i]) for i, (_, p) in got.items() if abs(x[i, 0]) > 0.5)
    alone = detectors.answer_classifier(df, ["g"], "id", features=("f1", "f2"))
    assert alone.where("p IS NULL").count() == 0 and alone.count() == 160


def test_matching_rules(spark):
    # id, candidate, pos, greedy, correct, in_pool, alias, s, cached
    rows = [
        (1, " Paris ", 0, "paris", True, True, False, 0.1, True), (1, "'paris'", 1, "paris", True, True, False, 0.2, True), (1, "Paname", 2, "paris", True, True, True, 0.3, True),
        (2, "'Shut it'", 0, "shut it", False, True, False, 0.1, True), (2, "ok", 1, "shut it", False, True, True, 0.1, True),
        (3, "held", 0, "held", False, False, False, 0.1, True), (3, "right", 1, "held", False, True, True, 0.4, True), (3, "hard", 2, "held", False, True, False, 0.9, True),
        (4, "a", 0, "zz", True, True, True, 0.1, True), (4, "b", 1, "zz", True, True, True, 0.7, True), (4, "c", 2, "zz", True, True, False, 0.9, False),
        (5, "a", 0, "zz", False, True, False, 0.5, False), (5, "b", 1, "zz", False, True, False, 0.5, True), (5, "t", 2, "zz", False, True, True, None, True),
        (6, "t", 0, "zz", True, True, True, 0.5, True), (6, "u", 1, "zz", True, True, False, None, True),
    ]
    df = spark.createDataFrame(rows, "id int, candidate string, pos int, greedy string, correct boolean, in_pool boolean, alias boolean, s double, cached boolean")
    assert {r.id: (r.candidate, r.kind) for r in matching.match_greedy(df).collect()} == {1: (" Paris ", "exact"), 2: ("'Shut it'", "loose"), 3: ("held", "exact"), 4: ("b", "gt_fallback"), 5: ("a", "hardest_distractor_fallback"), 6: ("t", "gt_fallback")}
    got = sorted((r.id, r.part, r.candidate, r.y) for r in matching.labelled_examples(df).collect())
    assert got == [
        (1, "greedy", " Paris ", 0), (1, "pair", "'paris'", 1), (1, "pair", "Paname", 0), (2, "greedy", "'Shut it'", 1), (2, "pair", "'Shut it'", 1), (2, "pair", "ok", 0),
        (3, "greedy", "held", 1), (3, "pair", "held", 1), (3, "pair", "right", 0), (6, "greedy", "t", 0), (6, "pair", "t", 0), (6, "pair", "u", 1),
    ]


def test_half_precision_patterns(spark):
    bits = np.array([0, 1, 512, 1023, 1024, 15360, 31743, 31744, 32768, 33000, 47104, 64512], np.uint16)
    got = spark.createDataFrame([(bits.astype(int).tolist(),), (bits.view(np.int16).astype(int).tolist(),)], "x array<int>").select(A.widened(F.col("x"))).collect()
    for row in got:
        assert np.array_equal(np.array(row[0], np.float32), bits.view(np.float16).astype(np.float32), equal_nan=True)


def test_recover_takes_one_row_for_each_part(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 1, 4.0), (2, 1, 9.0), (2, 2, None)], "k int, part int, v double")
    b = spark.createDataFrame([(1, 2, 7.0), (1, 2, 7.0), (1, 1, 0.0), (3, 1, 1.0)], "k int, part int, v double")
    need = spark.createDataFrame([(k, p) for k in (1, 2, 3) for p in (1, 2)] + [(1, 1)], "k int, part int")
    assert sorted(tuple(r) for r in boundary.recover(a, b, need, ["k"], "part", "v").collect()) == [(1, 1, 4.0), (1, 2, 7.0)]


def test_entailment_scores_and_classes(spark):
    logits = [0.3, -1.0, 2.0]
    p = np.exp(logits) / np.exp(logits).sum()
    row = spark.createDataFrame([(logits,)], "l array<double>").select(gen.probabilities(F.col("l")).alias("p")).select(*[gen.entailment_score(F.col("p"), v).alias(v) for v in ("strict", "luq", "weighted")]).first()
    assert np.allclose([row.strict, row.luq, row.weighted], [p[2], p[2] / (p[2] + p[0]), p[2] + p[1] / 2])
    with pytest.raises(ValueError):
        gen.entailment_score(F.col("p"), "none")
    one_hot = {0: [1.0, 0.0, 0.0], 1: [0.0, 1.0, 0.0], 2: [0.0, 0.0, 1.0]}
    pairs = [(a, b, 10 * a + b) for a in range(3) for b in range(3)]
    rows = [(q, 0, 1, one_hot[a]) for a, b, q in pairs] + [(q, 1, 0, one_hot[b]) for a, b, q in pairs]
    df = spark.createDataFrame(rows, "q int, i int, j int, p array<double>")
    for strict in (False, True):
        got = {(r.q, r.i): r.same for r in gen.equivalent_answers(df, "q", strict).collect()}
        assert all(got[q, 0] == got[q, 1] == ((a, b) == (2, 2) if strict else 0 not in (a, b) and (a, b) != (1, 1)) for a, b, q in pairs)


def test_missing_prefix_is_an_error(spark):
    pairs = spark.createDataFrame([("a_x", "x"), ("b_y", "y")], "pair string, dataset string")
    own = spark.createDataFrame([("a_x", "mine")], "pair string, prefix string")
    none = spark.createDataFrame([("x", "all")], "dataset string, prefix string")
    assert {r.pair: r.prefix for r in gen.prefixes(pairs, own, none.unionByName(spark.createDataFrame([("y", "rest")], "dataset string, prefix string"))).collect()} == {"a_x": "mine", "b_y": "rest"}
    with pytest.raises(Exception, match="no prefix for b_y"):
        gen.prefixes(pairs, own, none).collect()


def test_passes_reject_what_is_incomplete(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(Exception, match="lacking"):
        boundary.hidden_states(df, ["id"], ["id"], "m", lambda name: lambda rows: [{0: [1.0]} for _ in rows], [0, 1]).collect()
    with pytest.raises(Exception, match="heads"):
        boundary.value_norms(df, ["id"], ["id"], "v", lambda name: lambda rows: [{"layers.0": np.ones((2, 3))} for _ in rows], 2).collect()


def test_models_splits_and_samples_are_written_and_read(spark, tmp_path):
    model = spark.createDataFrame([("a", [1.0], [1.0], [0.5], 0.1)], "pair string, mu array<double>, sigma array<double>, weights array<double>, bias double")
    sinks.write_model(model, f"{tmp_path}/m", {"c": "1.0"}, spark.createDataFrame([("a", 0.9)], "pair string, auroc double"))
    assert sinks.read_model(spark, f"{tmp_path}/m").first().config == {"c": "1.0"} and spark.read.json(f"{tmp_path}/m/metrics").first().auroc == 0.9
    sinks.write_split(spark.createDataFrame([("train::2",), ("train::1",)], "id string"), f"{tmp_path}/s")
    assert [tuple(r) for r in readers.read_split(spark, f"{tmp_path}/s").collect()] == [("train::1", "train", 1), ("train::2", "train", 2)]
    ten = spark.range(10).toDF("k")
    assert sinks.copy_small(ten, f"{tmp_path}/c", 10, lambda d: d.limit(1)).count() == 10 and sinks.copy_small(ten, f"{tmp_path}/d", 9, lambda d: d.where("k = 1")).count() == 1
    assert readers.read_candidate_map(spark, f"{tmp_path}/none").count() == 0
    assert shared_folder(spark) == shared_folder(spark)


def test_result_tables(spark):
    df = spark.createDataFrame([("q", "m (best=a)", 1.0), ("p", "m (best=b)", float("nan")), ("z", "k", None), ("p", "a", 0.5)], "pair string, method string, v double")
    assert [(r.pair, r.method) for r in frames.in_result_order(df, ["p", "q"]).collect()] == [("p", "a"), ("p", "m (best=b)"), ("q", "m (best=a)"), ("z", "k")]
    assert {(r.method, r.v, r.n_pairs) for r in frames.method_means(df, ["v"]).collect()} == {("m", 1.0, 2), ("k", None, 1), ("a", 0.5, 1)}
    wide = spark.createDataFrame([(1, None, float("nan")), (2, 1.0, 1.0), (3, float("nan"), 2.0)], "id int, a double, b double")
    assert {(r.id, r.best, r.value) for r in frames.argmax_columns(wide, ["a", "b"]).collect()} == {(1, None, None), (2, "a", 1.0), (3, "b", 2.0)}
    means = spark.createDataFrame([("x", 0.7, 0.5), ("y", 0.6, 0.515)], "method string, t double, g double")
    assert not frames.pooled_verdict(means, "x", "y", ["t"], ["g"]).first().passed and frames.pooled_verdict(means, "x", "y", ["t"], ["g"], 0.02).first().passed
    with pytest.raises(ValueError):
        frames.grid(spark, ["a"], ["b"], ["a_c"])


def test_branches_that_queries_do_not_reach(spark):
    short = spark.createDataFrame([([3.0, 1.0], [10.0, 20.0])], "a array<double>, b array<double>")
    assert short.select(A.top_gather(F.col("a"), F.col("b"), 4).alias("x")).first().x == [10.0, 20.0, 20.0, 20.0]
    pairs = spark.createDataFrame([("m", "d", "mid")], "model string, dataset string, region string")
    wide = spark.createDataFrame([("m", "mid", [1, 2])], "model string, region string, layers array<int>")
    none = spark.createDataFrame([], "model string, dataset string, region string, layers array<int>")
    assert features.bucket_layers(pairs, wide, none, none, "wide").first().layers == [1, 2]
    with pytest.raises(Exception, match="no layers for m d mid"):
        features.bucket_layers(pairs, wide, none, none, "narrow").collect()
    blank = spark.createDataFrame([("a", 3, None), ("a", 4, None)], "g string, layer int, v double")
    assert features.widest_layer(blank, ["g"], "v", 40).first().layer == 20
    one = "struct<s_int:map<int,double>,s_ext:map<int,double>,n_tokens:int>"
    rows = [(1, {15: 0.5}, {3: -1.0}, 4, [({15: 0.2}, {3: -2.0}, 3)]), (2, {5: 0.5}, {3: -1.0}, 4, [({15: 0.2}, {3: -2.0}, 3)]), (3, {15: 0.5}, {}, 4, [({15: 0.2}, {3: -2.0}, 3)]), (4, {15: 0.5}, {3: -1.0}, 4, []), (5, {15: 0.5}, {3: -1.0}, 0, [({15: 0.2}, {3: -2.0}, 3)])]
    df = spark.createDataFrame(rows, f"id int, s_int map<int,double>, s_ext map<int,double>, n_tokens int, distractors array<{one}>")
    assert [r.id for r in features.detector_features(df, 15, 5, ["id"]).collect()] == [1]


def test_validation(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "k string, v double")
    rel.require_valid(rel.compare_tables(a, a, ["k"], "v"))
    b = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    with pytest.raises(ValueError, match="differ"):
        rel.require_valid(rel.compare_tables(a, b, ["k"], "v"))
    assert rel.validation(rel.compare_tables(a, b, ["k"], "v")).first().asDict() == {"n": 2, "differing": 1, "passed": False}


def test_rows_of_a_group_do_not_meet_to_find_its_models(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.rand(1).alias("f1"), F.rand(2).alias("f2"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = detectors.answer_classifier(rows.where("id >= 80 OR g = 1"), ["g"], "id", rows.where("id < 80 AND g = 0"), features=("f1", "f2"))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sided = [line for line in plan.splitlines() if "Join" in line and ("LeftSemi" in line or "LeftAnti" in line)]
    assert sided and all("BroadcastHashJoin" in line for line in sided)
