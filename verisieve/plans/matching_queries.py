"""Queries on matching, fallback lookups, literals and totals."""

from pyspark.sql import functions as F

from verisieve.functions import text as T
from verisieve.operators import boundary, matching
from verisieve.operators import relational as rel
from verisieve.plans.registry import query
from verisieve.sources.tables import table


@query("coalescing_lookup_all_layers", """WITH a AS (SELECT l_orderkey AS id, l_linenumber AS layer, min(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_orderkey AS id, l_linenumber AS layer, min(l_quantity) + 100 AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
need AS (SELECT o_orderkey AS id, unnest([1, 2]) AS layer FROM orders), j AS (SELECT need.id, coalesce(a.v, b.v) AS v FROM need LEFT JOIN a USING (id, layer) LEFT JOIN b USING (id, layer))
SELECT id, avg(v) AS mean FROM j GROUP BY id HAVING count(v) = 2""")
def coalescing_lookup_all_layers(spark, root):
    rows = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("v"), "l_linestatus", "l_returnflag")
    need = table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("layer"))
    got = boundary.recover(rows.where("l_linestatus = 'F'"), rows.where("l_returnflag = 'N'").withColumn("v", F.col("v") + 100), need, ["id"], "layer", "v")
    return got.groupBy("id").agg(F.avg("v").alias("mean"))


LINES = """line AS (SELECT l_orderkey AS id, l_linenumber AS pos, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2),
c AS (SELECT id, pos, s, lower(o_orderpriority) AS greedy, id % 2 = 0 AS correct, pos <> 3 AS in_pool, pos % 3 = 1 AS alias, (id + pos) % 7 > 0 AS cached,
  CASE WHEN pos = 1 AND id % 5 < 2 THEN ' ' || o_orderpriority WHEN pos = 2 AND id % 5 = 2 THEN '"' || o_orderpriority || '"' WHEN pos = 3 AND id % 5 = 3 THEN lower(o_orderpriority) ELSE 'x' || pos END AS candidate FROM line JOIN orders ON o_orderkey = id),
r AS (SELECT *, CASE WHEN in_pool AND lower(trim(candidate)) = greedy THEN 0 WHEN in_pool AND lower(trim(candidate, ' "')) = greedy THEN 1 WHEN cached AND candidate = greedy THEN 2 WHEN correct AND alias THEN 3 WHEN NOT correct AND NOT alias THEN 4 END AS rule FROM c),
g AS (SELECT id, candidate, s, cached, CASE rule WHEN 1 THEN 'loose' WHEN 3 THEN 'gt_fallback' WHEN 4 THEN 'hardest_distractor_fallback' ELSE 'exact' END AS kind FROM r WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rule, CASE WHEN rule > 2 THEN -s ELSE 0 END, pos) = 1)"""


def candidates(spark, root):
    line = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos")).agg(F.max("l_extendedprice").alias("s"))
    said, at, k = F.col("o_orderpriority"), F.col("pos"), F.col("id") % 5
    own = F.when((at == 1) & (k < 2), F.concat(F.lit(" "), said)).when((at == 2) & (k == 2), F.concat(F.lit('"'), said, F.lit('"'))).when((at == 3) & (k == 3), F.lower(said)).otherwise(F.concat(F.lit("x"), at.cast("string")))
    rows = line.join(table(spark, root, "orders"), F.col("o_orderkey") == F.col("id"))
    return rows.select("id", "pos", "s", F.lower(said).alias("greedy"), (F.col("id") % 2 == 0).alias("correct"), (at != 3).alias("in_pool"), (at % 3 == 1).alias("alias"), ((F.col("id") + at) % 7 > 0).alias("cached"), own.alias("candidate"))


@query("greedy_match_cascade", f"WITH {LINES} SELECT id, candidate, cached, kind FROM g")
def greedy_match_cascade(spark, root):
    return matching.match_greedy(candidates(spark, root)).select("id", "candidate", "cached", "kind")


@query("paired_examples", f"""WITH {LINES}, a AS (SELECT * FROM c WHERE alias QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) = 1), h AS (SELECT * FROM c WHERE NOT alias QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) = 1),
d AS (SELECT * FROM c WHERE NOT correct AND cached AND candidate = greedy QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
b AS (SELECT id, coalesce(d.candidate, h.candidate) AS candidate, CASE WHEN d.id IS NULL THEN h.s ELSE d.s END AS s, CASE WHEN d.id IS NULL THEN h.cached ELSE d.cached END AS cached FROM h FULL JOIN d USING (id)),
ok AS (SELECT a.id, a.correct FROM a JOIN b USING (id) WHERE a.cached AND b.cached)
SELECT 'pair' AS part, id, candidate, s, NULL AS kind, 0 AS y FROM a JOIN ok USING (id) UNION ALL SELECT 'pair', id, candidate, s, NULL, 1 FROM b JOIN ok USING (id)
UNION ALL SELECT 'greedy', id, candidate, s, kind, CASE WHEN ok.correct THEN 0 ELSE 1 END FROM g JOIN ok USING (id) WHERE g.cached""")
def paired_examples(spark, root):
    return matching.labelled_examples(candidates(spark, root)).select("part", "id", "candidate", "s", "kind", "y")


@query("layer_states", """WITH l AS (SELECT l_orderkey AS id, l_linenumber AS layer, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT id, list(v ORDER BY layer) AS states FROM l WHERE layer IN (1, 3) AND id % 2 = 0 GROUP BY id HAVING count(*) = 2""")
def layer_states(spark, root):
    """Keys with the vectors of both layers."""
    rows = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("layer")).agg(F.max("l_quantity").alias("v"))
    keys = table(spark, root, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    got = matching.layer_states(keys, rows.select("id", "layer", F.array("v").alias("vector")), [1, 3], ["id"])
    return got.select("id", F.flatten("states").alias("states"))


@query("totals_row", "SELECT coalesce(c_mktsegment, 'MEAN') AS segment, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment)")
def totals_row(spark, root):
    rows = table(spark, root, "orders").join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.rollup("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("MEAN")).alias("segment"), "mean", "n")


@query("config_parse", "SELECT event_id, CAST(event_id % 7 AS INTEGER) AS top_k, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 3 AS INTEGER) ELSE -1 END AS pca, round(-value, 6) AS score FROM events")
def config_parse(spark, root):
    said = F.concat(F.lit("top_k="), (F.col("event_id") % 7).cast("string"), F.lit(",pca="), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 3).cast("string")).otherwise("None"))
    number = F.concat(F.lit("tensor("), (-F.col("value")).cast("string"), F.lit(")"))
    return table(spark, root, "events").select("event_id", T.config_values(said, "top_k").alias("top_k"), F.coalesce(T.config_values(said, "pca"), F.lit(-1)).alias("pca"), F.round(T.repaired_number(number), 6).alias("score"))


@query("method_union_priority", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'late' ELSE 'early' END AS source FROM part")
def method_union_priority(spark, root):
    part = table(spark, root, "part")
    early = part.select(F.col("p_partkey").alias("id"), F.lit("early").alias("source"))
    late = part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit("late").alias("source"))
    return rel.union_by_priority([early, late], ["id"])


@query("verdict_fallback", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE value > 50 END AS verdict FROM events")
def verdict_fallback(spark, root):
    """A verdict in any spelling, else whether the accuracy is positive."""
    said = F.when(F.col("event_id") % 3 == 0, " True").when(F.col("event_id") % 3 == 1, "FALSE")
    return table(spark, root, "events").select("event_id", T.verdict(said, F.col("value") - 50).alias("verdict"))


@query("fenced_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def fenced_json(spark, root):
    """The object inside code fences and chatter."""
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(kind == 2, F.col("props")).otherwise("none")
    return table(spark, root, "events").select("event_id", F.from_json(T.first_object(said), "k long")["k"].alias("k"))


@query("validation_verdict", "WITH f AS (SELECT l_returnflag AS f, avg(l_discount) AS v FROM lineitem GROUP BY 1), c AS (SELECT v, CASE WHEN f = 'A' THEN v + 0.01 ELSE v + 1e-5 END AS w FROM f) SELECT count(*) AS n, count(*) FILTER (abs(v - w) > 5e-4) AS differing, count(*) FILTER (abs(v - w) > 5e-4) = 0 AS passed FROM c")
def validation_verdict(spark, root):
    flags = table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.avg("l_discount").alias("v"))
    changed = flags.withColumn("v", F.when(F.col("f") == "A", F.col("v") + 0.01).otherwise(F.col("v") + 1e-5))
    return rel.validation(rel.compare_tables(flags, changed, ["f"], "v"))
