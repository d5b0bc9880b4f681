"""Whole jobs, registered sources and the command line."""

import pytest

from verisieve.__main__ import main
from verisieve.operators import reports
from verisieve.plans import registry


def sources():
    made = reports.ScoreSources()

    @made.register("first")
    def first(spark, root):
        rows = [("p", i, m, "IH CH IL CL".split()[i % 4], float(i % 3 + (i % 4 == 0))) for m in ("a", "b") for i in range(40)]
        return spark.createDataFrame(rows, "pair string, id long, method string, category string, score double")

    @made.register("second")
    def second(spark, root):
        return spark.createDataFrame([("p", i, "b", "IH" if i < 2 else "CH", float(-i)) for i in range(4)] + [("q", 1, "b", None, 1.0)], "pair string, id long, method string, category string, score double")

    return made


def test_later_sources_replace_a_pair_and_method(spark, tmp_path):
    made = sources()
    assert made.names() == ["first", "second"]
    got = made.gather(spark, "").collect()
    assert sorted((r.pair, r.method) for r in got) == [("p", "a")] * 40 + [("p", "b")] * 4 + [("q", "b")]
    assert len(made.gather(spark, "", ["second", "first"]).collect()) == 81
    with pytest.raises(ValueError):
        made.gather(spark, "", ["third"])
    with pytest.raises(ValueError):
        made.register("first")(None)
    report = reports.category_job(spark, made, "", str(tmp_path), ["q", "p"])
    table = {(r.pair, r.method): r for r in reports.category_table(made.gather(spark, "")).collect()}
    assert table["p", "b"].IHvCH == 1.0 and table["p", "b"].ILvCL is None and (table["q", "b"].n, table["q", "b"].n_IH) == (1, 0)
    lines = report.splitlines()
    assert lines[4] == "| q | b | 1 | — | — | — | — |" and "| b | 1.0000 | — | — | — | 2 |" in lines
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == lines


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double").write.parquet(f"{tmp_path}/x")
    spark.createDataFrame([("a", 0.5001), ("b", None)], "k string, v double").write.parquet(f"{tmp_path}/y")
    (tmp_path / "z.csv").write_text("k,v\na,0.9\nb,\n")
    assert main(["validate", f"{tmp_path}/x", f"{tmp_path}/y", "--key", "k", "--value", "v"]) == 0
    assert main(["validate", f"{tmp_path}/x", f"{tmp_path}/z.csv", "--key", "k", "--value", "v"]) == 1
    assert "FAIL" in capsys.readouterr().out
    assert main(["list"]) == 0 and "auroc_by_lang" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["query", "no such", "--root", "r", "--out", "o"])
    registry.QUERIES["_one"] = lambda spark, root: spark.range(3)
    try:
        assert main(["query", "_one", "--root", "r", "--out", f"{tmp_path}/q"]) == 0
    finally:
        del registry.QUERIES["_one"]
    assert spark.read.parquet(f"{tmp_path}/q").count() == 3


def test_specialists_and_their_guards(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(1)
    rows = [(pair, i, "IH CH IL CL".split()[i % 4], [float(v) for v in r.standard_normal(3) + (i % 4 == 0) * 1.5]) for pair in ("p", "q") for i in range(240)]
    rows += [("few", i, "IH CH".split()[i % 2], [0.0, 1.0, float(i)]) for i in range(10)] + [("p", 999, "?", [1.0, 1.0, 1.0]), ("p", 1000, "IH", None)]
    df = reports.banded(spark.createDataFrame(rows, "pair string, id long, category string, x array<double>"))
    assert df.where("band = 'HI' AND y = 1").select("category").distinct().collect() == [("IH",)]
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    got = {(x.pair, x.method, x.band): x for x in reports.specialist_rows(train, test, {"all": F.col("x"), "one (best=k=1)": F.slice("x", 1, 1)}, least=10).collect()}
    assert len(got) == 2 * (2 * 2 + 1)
    few = got["few", "all", "HI"]
    assert few.auroc_specialist is None and few.n_tr_pos + few.n_tr_neg + few.n_te_pos + few.n_te_neg == 10
    assert got["p", "all", "HI"].auroc_specialist > 0.8 and got["p", "all", "HI"].n_te_pos == 20
    table = spark.createDataFrame([("p", "all", 0.5, 0.25), ("p", "one", 0.75, None)], "pair string, method string, IHvCH double, ILvCL double")
    told = {(x.pair, x.method, x.band): x for x in reports.with_generalist(spark.createDataFrame(list(got.values())), table).collect()}
    assert told["p", "one (best=k=1)", "HI"].auroc_generalist == 0.75 and told["p", "one (best=k=1)", "LO"].delta is None
    assert abs(told["p", "all", "LO"].delta - (told["p", "all", "LO"].auroc_specialist - 0.25)) < 1e-12
    report = reports.specialist_job(spark.createDataFrame(list(got.values())), table, str(tmp_path))
    assert any(line.startswith("| HI | all | 0.") for line in report.splitlines())


def test_repeated_ids_do_not_multiply(spark):
    from verisieve.operators import frames

    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    b = spark.createDataFrame([(1, 5, None), (1, 4, 9), (2, None, 1), (2, 7, 2)], "id long, v int, w int")
    c = spark.createDataFrame([(1,), (1,), (2,), (4,)], "id long")
    assert sorted(map(tuple, frames.common_rows([a, b, c], ["id"]).collect()), key=str) == [(1, "a", 4, 9), (2, "b", None, 1)]
