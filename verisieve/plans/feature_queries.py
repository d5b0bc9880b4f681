"""Queries on detector features, layers, distractors, prompts and neural boundaries."""

import hashlib

from pyspark.sql import functions as F

from verisieve.functions import arrays as A
from verisieve.functions import text as T
from verisieve.operators import boundary, features
from verisieve.operators import generations as gen
from verisieve.operators import relational as rel
from verisieve.plans.registry import query
from verisieve.plans.vector_queries import E, six, vectors
from verisieve.sources.tables import table

NAMES = ("f1", "f2", "f3", "f4", "f5", "f6", "f7", "f8", "g1", "g2", "g4", "g8")


@query("detector_features", """WITH line AS (SELECT l_orderkey, l_linenumber, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_extendedprice) AS l_extendedprice, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey AS id, min(l_linenumber) AS g FROM line GROUP BY 1),
a AS (SELECT id, l_linenumber <> g AS dist, l_discount AS b, CASE WHEN l_linenumber % 3 > 0 THEN l_tax END AS e, -l_extendedprice / 50000 AS x, l_quantity AS n FROM line JOIN d ON id = l_orderkey),
s AS (SELECT id, sum(b) FILTER (NOT dist) AS f1, sum(x) FILTER (NOT dist) AS f2, sum(n) FILTER (NOT dist) AS g1, sum(e) FILTER (NOT dist) AS e, avg(b) FILTER (dist) AS m, var_pop(b) FILTER (dist) AS f5, max(b) FILTER (dist) AS mx, avg(exp(x)) FILTER (dist) AS mp, avg(n) FILTER (dist) AS ml FROM a GROUP BY id),
v AS (SELECT a.id, avg(CASE WHEN f1 > b THEN 1.0 ELSE 0.0 END) AS f7 FROM a JOIN s USING (id) WHERE dist GROUP BY a.id)
SELECT id, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f1 - m, 6) AS f3, round(f1 - m - (exp(f2) - mp), 6) AS f4, round(f5, 6) AS f5, round(mx - f1, 6) AS f6, round(f7, 6) AS f7, round(coalesce(f1 - e, 0), 6) AS f8, round(g1, 6) AS g1, round(f2 / g1, 6) AS g2, round((f1 + coalesce(e, 0)) / (CASE WHEN e IS NULL THEN 1 ELSE 2 END), 6) AS g4, round(g1 - ml, 6) AS g8 FROM s JOIN v USING (id)""")
def detector_features(spark, root):
    one = F.struct(
        F.map_from_arrays(F.array(F.lit(15), F.lit(5)), F.array(F.col("l_discount").cast("double"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_tax").cast("double")))).alias("s_int"),
        F.create_map(F.lit(31), (-F.col("l_extendedprice") / 50000).cast("double"), F.lit(2), F.lit(0.0)).alias("s_ext"), F.col("l_quantity").alias("n_tokens"),
    )
    least = [F.min(c).alias(c) for c in ("l_discount", "l_tax", "l_extendedprice", "l_quantity")]
    line = table(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*least).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), one.alias("one"))
    many = line.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "one")), lambda a, b: a["pos"] - b["pos"]).alias("l"))
    rows = many.select("id", F.col("l")[0]["one"].alias("g"), F.transform(F.slice("l", 2, F.size("l")), lambda x: x["one"]).alias("distractors")).select("id", "g.*", "distractors")
    got = features.detector_features(rows, 15, 5, ["id"])
    return got.select("id", *[F.round(F.col(n), 6).alias(n) for n in NAMES])


LAYERS = f"x AS (SELECT vec_id, label, unnest({E}[1:32]) AS s, unnest({E}[33:64]) AS o, unnest(range(32)) AS layer FROM embeddings)"


@query("layer_peak_selection", f"""WITH {LAYERS}, w AS (SELECT label, layer, s, CASE WHEN s > o THEN 1 ELSE 0 END AS y FROM x), r AS (SELECT *, rank() OVER (PARTITION BY label, layer ORDER BY s) + (count(*) OVER (PARTITION BY label, layer, s) - 1) / 2.0 AS rk FROM w),
a AS (SELECT label, layer, count(*) AS n, sum(y) AS p, sum(rk * y) AS t FROM r GROUP BY ALL), b AS (SELECT label, layer, (t - p * (p + 1) / 2.0) / (p * (n - p)) AS auroc FROM a WHERE n >= 10 AND p > 0 AND p < n),
g AS (SELECT DISTINCT label, unnest(['mid', 'late']) AS region FROM embeddings), c AS (SELECT label, CASE WHEN layer BETWEEN 8 AND 19 THEN 'mid' ELSE 'late' END AS region, layer, auroc FROM b WHERE layer BETWEEN 8 AND 31),
best AS (SELECT label, region, layer, auroc FROM c QUALIFY row_number() OVER (PARTITION BY label, region ORDER BY auroc DESC, layer) = 1)
SELECT label, region, CAST(coalesce(layer, CASE region WHEN 'mid' THEN 14 ELSE 26 END) AS INTEGER) AS peak, round(auroc, 6) AS auroc FROM g LEFT JOIN best USING (label, region)""")
def layer_peak_selection(spark, root):
    x = vectors(spark, root).select("label", F.posexplode(F.zip_with(F.slice("e", 1, 32), F.slice("e", 33, 32), lambda a, b: F.struct(a.alias("s"), b.alias("o")))).alias("layer", "v")).select("label", "layer", "v.*")
    scores = features.layer_auroc(x, ["label"], "s", "o")
    dim = spark.createDataFrame([("mid", list(range(8, 20))), ("late", list(range(20, 32)))], "region string, layers array<int>")
    regions = vectors(spark, root).select("label").distinct().join(F.broadcast(dim), F.lit(True))
    return features.peak_layers(scores, regions, ["label"]).select("label", "region", "peak", F.round("auroc", 6).alias("auroc"))


@query("layer_auto_selection", f"WITH {LAYERS}, m AS (SELECT label, layer, avg(abs(s)) AS m FROM x GROUP BY ALL) SELECT label, CAST(layer AS INTEGER) AS layer FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(m, 12) DESC, layer) = 1")
def layer_auto_selection(spark, root):
    x = vectors(spark, root).select("label", F.posexplode(F.slice("e", 1, 32)).alias("layer", "s"))
    return features.widest_layer(x, ["label"], "s", 32)


@query("peak_window_clip", "SELECT vec_id, list_filter(range(CAST(vec_id % 32 - 2 AS INTEGER), CAST(vec_id % 32 + 3 AS INTEGER)), lambda x: x >= 8 AND x <= 19) AS layers, list_filter([5, 10, 25, 50, 100], lambda k: k <= greatest(vec_id % 120, 5)) AS grid FROM embeddings")
def peak_window_clip(spark, root):
    peak = (F.col("vec_id") % 32).cast("int")
    return vectors(spark, root).select("vec_id", A.peak_window(peak, 8, 19).cast("array<bigint>").alias("layers"), A.k_grid(F.greatest(F.col("vec_id") % 120, F.lit(5))).alias("grid"))


@query("gqa_head_map", f"""WITH q AS (SELECT vec_id, unnest(range(4)) AS head, {E} AS e FROM embeddings) SELECT vec_id, CAST(head AS INTEGER) AS head, CAST(head // 2 AS INTEGER) AS kv_head, round(list_dot_product(e[head * 8 + 1:head * 8 + 8], e[32 + (head // 2) * 8 + 1:32 + (head // 2) * 8 + 8]), 6) AS fused FROM q""")
def gqa_head_map(spark, root):
    cut = lambda at, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda h: F.slice("e", at + h * 8 + 1, 8))
    q = vectors(spark, root).select("vec_id", F.posexplode(cut(0, 4)).alias("head", "d"))
    v = vectors(spark, root).select("vec_id", F.posexplode(cut(32, 2)).alias("head", "norm"))
    return features.shared_heads(q, v, ["vec_id"], 2, "d", "norm").select("vec_id", "head", "kv_head", *six(("fused", A.dot(F.col("d"), F.col("norm")))))


@query("bucket_layer_lookup", """SELECT label, region, CASE WHEN label % 2 = 0 THEN [label, 9] ELSE [7, 8] END AS layers FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL), (VALUES ('mid'), ('late')) r(region)""")
def bucket_layer_lookup(spark, root):
    labels = vectors(spark, root).where("label IS NOT NULL").select(F.col("label").cast("bigint").alias("label")).distinct()
    pairs = labels.withColumn("region", F.explode(F.array(F.lit("mid"), F.lit("late")))).select("label", F.lit("m").alias("model"), F.col("label").cast("string").alias("dataset"), "region")
    fixed = pairs.where("label % 2 = 0").select("model", "dataset", "region", F.array("label", F.lit(9).cast("bigint")).alias("layers"))
    computed = pairs.select("model", "dataset", "region", F.array(F.lit(7).cast("bigint"), F.lit(8).cast("bigint")).alias("layers"))
    wide = spark.createDataFrame([("m", "mid", [1]), ("m", "late", [2])], "model string, region string, layers array<bigint>")
    rows = pairs.join(F.broadcast(wide.withColumnRenamed("layers", "_w")), ["model", "region"], "left").drop("_w")
    return features.bucket_layers(rows, wide, fixed, computed, "narrow").select("label", "region", "layers")


@query("distractor_rules", """WITH c AS (SELECT p_partkey AS id, p_brand AS truth, p_type AS greedy, CASE p_partkey % 4 WHEN 0 THEN [p_type, p_name, 'x'] WHEN 1 THEN [p_type, p_brand] WHEN 2 THEN [p_name, ' ', 'y'] END AS items FROM part)
SELECT id, list_filter([CASE WHEN items IS NULL THEN 'missing' END, CASE WHEN len(items) <> 3 THEN 'not_three' END, CASE WHEN list_contains(items, ' ') THEN 'empty' END, CASE WHEN lower(trim(items[1])) <> lower(trim(greedy)) THEN 'greedy_first' END, CASE WHEN list_contains(list_transform(items, lambda v: lower(trim(v))), lower(trim(truth))) THEN 'is_truth' END], lambda v: v IS NOT NULL) AS broken FROM c""")
def distractor_rules(spark, root):
    at = F.col("p_partkey") % 4
    items = F.when(at == 0, F.array("p_type", "p_name", F.lit("x"))).when(at == 1, F.array("p_type", "p_brand")).when(at == 2, F.array("p_name", F.lit(" "), F.lit("y")))
    return table(spark, root, "part").select(F.col("p_partkey").alias("id"), T.distractor_violations(items, F.col("p_brand"), F.col("p_type"), F.lit(True)).alias("broken"))


@query("alias_lists", "SELECT n_nationkey AS id, n_name AS first, CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'b''c'] ELSE [n_name] END AS names FROM nation")
def alias_lists(spark, root):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("['"), F.col("n_name"), F.lit("', \"b'c\"]"))).otherwise(F.col("n_name"))
    return table(spark, root, "nation").select(F.col("n_nationkey").alias("id"), T.first_of_list(text).alias("first"), T.aliases(text).alias("names"))


@query("map_generations", """WITH t AS (SELECT conv_id AS id, turn, trim(text) AS a FROM conversations), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn, a) <= 10)
SELECT CAST(id AS VARCHAR) AS id, count(*) AS n FROM f WHERE a <> '' GROUP BY 1 HAVING count(*) >= 2""")
def map_generations(spark, root):
    turns = table(spark, root, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.trim("text").alias("a")))), lambda x: x["a"]).alias("responses"))
    line = F.to_json(F.create_map(F.col("conv_id").cast("string"), F.struct("responses")))
    return turns.select(F.inline(gen.answers_of_map(line))).select("id", F.size("answers").cast("bigint").alias("n"))


@query("prompt_templates", "SELECT item_id, 'Question: ' || coalesce(text, '') || chr(10) || 'Answer (' || item_id || '):' AS prompt FROM benchmark")
def prompt_templates(spark, root):
    return table(spark, root, "benchmark").select("item_id", boundary.prompt_text("Question: {q}\nAnswer ({id}):", q=F.col("text"), id=F.col("item_id")).alias("prompt"))


def digest_model(name):
    """A stand-in model: digests of its name and inputs."""
    return lambda rows: [hashlib.md5(f"{name}|{r[0]}".encode()).hexdigest() for r in rows]


@query("boundary_model", "SELECT event_id, md5('stand-in|' || event_id) AS out FROM events WHERE event_type <> 'purchase'")
def boundary_model(spark, root):
    events = table(spark, root, "events")
    todo = rel.pending(events, events.where("event_type = 'purchase'"), ["event_id"])
    return boundary.run_model(todo.select("event_id"), "stand-in", digest_model, ["event_id"], ["event_id"], "string")


def shy_judge(name):
    """A stand-in judge that answers even-lengthed prompts at once, others when warm."""
    return lambda prompts, heat: [f"{len(p)}" if heat > 0 or len(p) % 2 == 0 else "" for p in prompts]


@query("boundary_judge_retries", "SELECT item_id, CAST(length(text) AS VARCHAR) AS reply, CAST(1 + length(text) % 2 AS INTEGER) AS tries, true AS ok FROM benchmark")
def boundary_judge_retries(spark, root):
    return boundary.run_judge(table(spark, root, "benchmark"), "judge", shy_judge, "text", "item_id", str.isdigit)


@query("recover_missing_states", """WITH r AS (SELECT o_orderkey AS id, unnest([1, 2]) AS layer FROM orders), a AS (SELECT l_orderkey AS id, l_linenumber AS layer, min(l_quantity) FILTER (l_linestatus = 'F') AS m, min(l_quantity) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1, 2),
j AS (SELECT r.id, r.layer, coalesce(m, n) AS v FROM r LEFT JOIN a USING (id, layer)), k AS (SELECT id FROM j GROUP BY id HAVING count(v) = 2) SELECT id, CAST(layer AS INTEGER) AS layer, v FROM j JOIN k USING (id)""")
def recover_missing_states(spark, root):
    need = table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("layer"))
    a = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("v"), "l_linestatus", "l_returnflag")
    return boundary.recover(a.where("l_linestatus = 'F'"), a.where("l_returnflag = 'N'"), need, ["id"], "layer", "v")


@query("token_span", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN [3] ELSE [CAST(p_partkey % 3 + 7 AS INTEGER), 3] END AS span FROM part")
def token_span(spark, root):
    prompt = F.array(F.lit(1), F.lit(2), F.lit(7))
    k = (F.col("p_partkey") % 3).cast("int")
    full = F.when(k == 0, F.array(F.lit(1), F.lit(2), F.lit(7), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2), k + 7, F.lit(3)))
    return table(spark, root, "part").select(F.col("p_partkey").alias("id"), boundary.answer_span(prompt, full).alias("span"))
