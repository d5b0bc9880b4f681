"""Queries that write a table in a text or layered format and read it back through the readers.

They write below spark.checkpoint.dir; without it only a session in one process can run them.
"""

import uuid

from pyspark.sql import functions as F

from verisieve.operators import relational as rel
from verisieve.plans.registry import query
from verisieve.sources import readers, sinks
from verisieve.sources.tables import shared_folder, table


def scratch(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("csv_samples", """SELECT CAST(item_id AS VARCHAR) AS id, text AS question, 't' || item_id AS ground_truth, 'it''s ' || item_id AS greedy_prediction, item_id % 2 = 0 AS open_text_label, ['t' || item_id, 'other ' || item_id] AS candidate_pool, item_id / 4.0 AS c_metric FROM benchmark""")
def csv_samples(spark, root):
    n = F.col("item_id").cast("string")
    raw = table(spark, root, "benchmark").select(
        n.alias("id"), F.col("text").alias("question"), F.concat(F.lit("['t"), n, F.lit("', 'u']")).alias("ground_truth"), F.concat(F.lit(' it"s '), n, F.lit(" ")).alias("low_t_generation"),
        F.concat(F.lit("['T"), n, F.lit(" ', 'other "), n, F.lit("', 'Other "), n, F.lit("']")).alias("candidates"), F.when(F.col("item_id") % 2 == 0, "True").otherwise("false").alias("LLM_verdict"),
        F.lit("incorrect_low").alias("category"), (F.col("item_id") / 4).cast("string").alias("C_metric"),
    )
    path = scratch(spark)
    sinks.write_csv(raw, path, raw.columns)
    return readers.read_samples_csv(spark, path).select("id", "question", "ground_truth", "greedy_prediction", "open_text_label", "candidate_pool", "c_metric")


@query("jsonl_records", "SELECT CAST(l_orderkey AS VARCHAR) AS id, l_returnflag AS candidate, count(*) AS n, round(sum(l_quantity), 4) AS s FROM lineitem GROUP BY ALL")
def jsonl_records(spark, root):
    rows = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("candidate")).agg(F.count("*").cast("int").alias("n_answer_tokens"), F.round(F.sum("l_quantity"), 4).alias("s_ext"))
    path = scratch(spark)
    sinks.write_json(rows, path)
    return readers.read_records(spark, path).select("id", "candidate", F.col("n_answer_tokens").cast("bigint").alias("n"), F.col("s_ext").alias("s"))


@query("score_csv_repair", "SELECT CAST(event_id AS VARCHAR) AS event_id, round(value, 4) AS score FROM events WHERE event_id % 5 > 0")
def score_csv_repair(spark, root):
    said = F.when(F.col("event_id") % 5 == 0, "nan").otherwise(F.concat(F.lit("tensor("), F.format_string("%.4f", F.col("value")), F.lit(")")))
    path = scratch(spark)
    sinks.write_csv(table(spark, root, "events").select("event_id", said.alias("score")), path, ["event_id", "score"])
    return readers.read_scores(spark, path, "event_id", "score").select("event_id", F.round("score", 4).alias("score"))


@query("layered_vectors", "SELECT CAST(label AS INTEGER) AS layer, count(*) AS n FROM embeddings WHERE label >= 5 GROUP BY label")
def layered_vectors(spark, root):
    rows = table(spark, root, "embeddings").where("label IS NOT NULL").select("vec_id", "embedding", F.col("label").alias("layer"), F.lit("m").alias("model"), F.lit("d").alias("dataset"))
    path = scratch(spark)
    sinks.write_layers(rows, path)
    return readers.read_layers(spark, path, 5).groupBy("layer").agg(F.count("*").alias("n"))


@query("layers_present", "SELECT DISTINCT CAST(label AS INTEGER) AS layer FROM embeddings WHERE label >= 7")
def layers_present(spark, root):
    rows = table(spark, root, "embeddings").where("label IS NOT NULL").select("vec_id", F.col("label").alias("layer"), F.lit("m").alias("model"), F.lit("d").alias("dataset"))
    path = scratch(spark)
    sinks.write_layers(rows, path)
    return readers.layers_present(spark, path, 7)


@query("resume_append", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def resume_append(spark, root):
    events, path = table(spark, root, "events").select("event_id", "event_type"), scratch(spark)
    sinks.resume(events.where("event_type <> 'purchase'"), path, ["event_id"], lambda todo: todo)
    return sinks.resume(events, path, ["event_id"], lambda todo: todo, batch_rows=10_000).groupBy("event_type").agg(F.count("*").alias("n"))


@query("staged_promote", "SELECT count(*) AS n FROM customer")
def staged_promote(spark, root):
    rows, path = table(spark, root, "customer"), scratch(spark)
    sinks.promote(rows.where("c_custkey = 1"), path, rows.where("c_custkey = 1"), ["c_custkey"])
    sinks.promote(rows, path, rows, ["c_custkey"])
    return sinks.read_current(spark, path).agg(F.count("*").alias("n"))


@query("config_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS v FROM customer")
def config_upsert(spark, root):
    old = table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return rel.upsert(old, old.where("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


@query("first_match_lookup", "SELECT o_orderkey AS k, arg_min(l_quantity, l_linenumber) AS v FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def first_match_lookup(spark, root):
    """Of equal line numbers the first row of the files, as the SQL gives it on one thread."""
    placed, place = readers.in_row_order(table(spark, root, "lineitem"))
    records = placed.select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_quantity").alias("v"), *place)
    return readers.lookup(table(spark, root, "orders").select(F.col("o_orderkey").alias("k")), records, ["k"], ["l_linenumber", *place]).select("k", "v")


@query("report_cells", "SELECT l_returnflag AS f, printf('%.4f', avg(l_discount)) AS cell FROM lineitem GROUP BY 1 UNION ALL SELECT 'none', '—'")
def report_cells(spark, root):
    rows = table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.avg("l_discount").alias("v"))
    return rows.unionByName(spark.createDataFrame([("none", float("nan"))], "f string, v double")).select("f", sinks.cell(F.col("v")).alias("cell"))


@query("skip_if_complete", "SELECT 'first' AS build, count(*) AS n FROM region UNION ALL SELECT 'again', count(*) FROM nation")
def skip_if_complete(spark, root):
    """A complete table is not built again, unless that is asked for."""
    path = scratch(spark)
    one, other = (table(spark, root, t).select(F.col(c).alias("k")) for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey")))
    sinks.materialise(spark, path, lambda: one)
    n = sinks.materialise(spark, path, lambda: other).count()
    again = sinks.materialise(spark, path, lambda: other, overwrite=True)
    return again.agg(F.lit("again").alias("build"), F.count("*").alias("n")).unionByName(spark.createDataFrame([("first", n)], "build string, n long"))


@query("model_artifact", "SELECT n_regionkey AS pair, [CAST(min(n_nationkey) AS DOUBLE), CAST(count(*) AS DOUBLE)] AS weights, '0.1' AS c, count(*) AS n FROM nation GROUP BY 1")
def model_artifact(spark, root):
    rows = table(spark, root, "nation").groupBy(F.col("n_regionkey").alias("pair")).agg(F.array(F.min("n_nationkey").cast("double"), F.count("*").cast("double")).alias("weights"), F.count("*").alias("n"))
    path = scratch(spark)
    sinks.write_model(rows.select("pair", "weights"), path, {"c": "0.1"}, rows.select("pair", "n"))
    metrics = spark.read.schema("pair int, n long").json(f"{path}/metrics")
    return sinks.read_model(spark, path).select("pair", "weights", F.col("config")["c"].alias("c")).join(metrics, "pair")


@query("last_record_wins", "SELECT CAST(event_id // 2 AS VARCHAR) AS id, max(event_id) AS last FROM events GROUP BY 1")
def last_record_wins(spark, root):
    """Of repeated keys the last line stays."""
    rows = table(spark, root, "events").select((F.floor(F.col("event_id") / 2)).cast("string").alias("id"), F.lit("c").alias("candidate"), F.col("event_id").cast("double").alias("s_ext"))
    path = scratch(spark)
    sinks.write_json(rows, path, order=["s_ext"])  # the order of the lines is what is read
    return readers.read_records(spark, path).select("id", F.col("s_ext").cast("long").alias("last"))
