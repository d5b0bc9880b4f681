"""Writers that are interrupted, read meanwhile, or split."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verisieve.plans import registry
from verisieve.sources import readers, sinks
from verisieve.sources.tables import shared_folder


def test_a_killed_run_loses_one_batch(spark, tmp_path):
    path, source, calls = str(tmp_path / "t"), spark.range(1000).withColumn("v", F.col("id") * 2), []

    def process(todo):
        calls.append(todo.count())
        if len(calls) == 3:
            raise KeyboardInterrupt
        return todo

    with pytest.raises(KeyboardInterrupt):
        sinks.resume(source, path, ["id"], process, batch_rows=200)
    kept = spark.read.parquet(path).count()
    assert kept == calls[0] + calls[1] > 0
    out = sinks.resume(source, path, ["id"], process, batch_rows=200)
    assert sum(calls[3:]) == 1000 - kept and out.count() == out.select("id").distinct().count() == 1000
    done = len(calls)
    assert sinks.resume(source, path, ["id"], process, batch_rows=200).count() == 1000 and len(calls) == done
    assert sinks.resume(source.where("false"), str(tmp_path / "e"), ["id"], lambda todo: todo).count() == 0


def test_readers_always_see_a_whole_table(spark, tmp_path):
    path, seen, stop = str(tmp_path / "t"), [], threading.Event()
    sinks.promote(spark.range(10), path, spark.range(10), ["id"])

    def read():
        while not stop.is_set():
            seen.append(sinks.read_current(spark, path).count())

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in (20, 30, 40):
            sinks.promote(spark.range(n), path, spark.range(n), ["id"])
    finally:
        stop.set()
        reader.join()
    assert seen and set(seen) <= {10, 20, 30, 40} and sinks.read_current(spark, path).count() == 40
    with pytest.raises(ValueError):
        sinks.promote(spark.range(5), path, spark.range(6), ["id"])
    assert sinks.read_current(spark, path).count() == 40
    (tmp_path / "t" / "_manifests" / "000000000009").write_text("version-half")  # a manifest that is being written
    assert sinks.read_current(spark, path).count() == 40
    with pytest.raises(ValueError):
        sinks.read_current(spark, str(tmp_path / "none"))


def test_scores_are_read_by_several_tasks_and_the_last_row_wins(spark, tmp_path):
    lines = [f"{i % 5000},tensor({i})" for i in range(20_000)]
    for name, some in (("a.csv", lines[:12_000]), ("b.csv", lines[12_000:])):
        (tmp_path / name).write_text("id,s\n" + "\n".join(some) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert readers.read_csv(spark, str(tmp_path), line_breaks=False).rdd.getNumPartitions() > 5
        got = {int(r.id): r.s for r in readers.read_scores(spark, str(tmp_path), "id", "s").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {k: 15_000.0 + k for k in range(5000)}


def test_a_large_layer_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(4000).select(F.lit("m").alias("model"), F.lit("d").alias("dataset"), F.when(F.col("id") < 10, 1).otherwise(2).alias("layer"), "id", F.array(*[F.rand(i) for i in range(20)]).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40k")
    try:
        sinks.write_layers(df.repartition(8), str(tmp_path / "l"))
        sinks.write_bundle(df.repartition(8), str(tmp_path / "b"), ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for path in ("l/model=m/dataset=d/layer=2", "b/layer=2"):
        assert len(list((tmp_path / path).glob("*.parquet"))) > 2
    assert readers.read_layers(spark, str(tmp_path / "l"), 2).count() == 3990


def test_ties_of_a_lookup_go_by_place_in_the_files(spark, tmp_path):
    line = lambda frm, to, v: spark.range(frm, to, numPartitions=1).select((F.col("id") % 40).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") + v).cast("double").alias("l_quantity"))
    for name, some in (("a", line(0, 40, 0)), ("b", line(0, 20_000, 1000))):  # the larger file is read first
        (part,) = [p for p in (some.write.parquet(str(tmp_path / name)), (tmp_path / name).glob("part*.parquet"))[1]]
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        part.rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    spark.range(41).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.k: r.v for r in registry.QUERIES["first_match_lookup"](spark, str(tmp_path)).collect()}
    assert got == {k: float(k) for k in range(40)} | {40: None}


def test_lines_in_order_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("id"), F.lit("c").alias("candidate"), F.col("id").cast("double").alias("s_ext")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_json(rows, str(tmp_path / "r"), order=["s_ext"])
        root = tmp_path / "t"
        spark.range(4000).select(F.col("id").alias("event_id")).repartition(3).write.parquet(str(root / "events.parquet"))
        got = {r.id: r.last for r in registry.QUERIES["last_record_wins"](spark, str(root)).collect()}
        folder = max((p for p in Path(shared_folder(spark)).iterdir() if list(p.glob("*.json"))), key=lambda p: p.stat().st_mtime)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "r").glob("*.json"))
    told = [json.loads(line)["s_ext"] for f in files for line in f.read_text().splitlines()]
    assert len(files) > 1 and told == [float(i) for i in range(20_000)]
    assert {int(r.id): r.s_ext for r in readers.read_records(spark, str(tmp_path / "r")).collect()} == {k: 15_000.0 + k for k in range(5000)}
    assert got == {str(k): 2 * k + 1 for k in range(2000)} and len(list(folder.glob("*.json"))) > 1  # no task writes all


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    source, seen = spark.range(2000, numPartitions=3).withColumns({"_batch": F.lit("own"), "v": F.col("id") * 2}), []

    def process(todo):
        where = todo.inputFiles()
        seen.append((set(where), spark.read.schema(todo.schema).parquet(*where).count(), todo.count()))
        return todo

    out = sinks.resume(source, str(tmp_path / "t"), ["id"], process, batch_rows=100)
    assert len(seen) == 20 and all(read == mine for _, read, mine in seen)
    assert len(set().union(*[files for files, *_ in seen])) == sum(len(files) for files, *_ in seen)
    assert sorted(map(tuple, out.select("id", "_batch", "v").collect())) == [(i, "own", 2 * i) for i in range(2000)]
    few = sinks.resume(spark.range(3), str(tmp_path / "few"), ["id"], lambda todo: todo, batch_rows=1)  # some batches have no key
    assert sorted(r.id for r in few.collect()) == [0, 1, 2]
