"""Queries on vectors, text and lookups; star-schema and embedding tables stand in."""

from pyspark.sql import functions as F

from verisieve.functions import arrays as A
from verisieve.functions import text as T
from verisieve.operators import frames
from verisieve.operators import generations as gen
from verisieve.operators import relational as rel
from verisieve.operators.vectors import mean_and_deviation
from verisieve.plans.registry import query
from verisieve.sources.tables import table

E = "CAST(embedding AS DOUBLE[])"


def vectors(spark, root):
    return table(spark, root, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def six(*cols):
    return [A.rounded(c, 6).alias(n) for n, c in cols]


@query("topk_values", f"SELECT vec_id, list_transform(list_sort({E}, 'DESC')[1:10], lambda x: round(x, 6)) AS top FROM embeddings")
def topk_values(spark, root):
    return vectors(spark, root).select("vec_id", F.transform(A.top_values(F.col("e"), 10), lambda x: A.rounded(x, 6)).alias("top"))


@query("topk_gather_product", f"""WITH p AS (SELECT vec_id, unnest({E}[1:32]) AS d, unnest({E}[33:64]) AS v, unnest(range(32)) AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, i) AS rk FROM p) SELECT vec_id, round(sum(d * v), 6) AS fused, round(sum(d), 6) AS sink FROM r WHERE rk <= 5 GROUP BY vec_id""")
def topk_gather_product(spark, root):
    d, v = F.slice("e", 1, 32), F.slice("e", 33, 32)
    return vectors(spark, root).select("vec_id", *six(("fused", A.dot(A.top_values(d, 5), A.top_gather(d, v, 5))), ("sink", A.total(A.top_values(d, 5)))))


@query("vector_summaries", f"""SELECT vec_id, round(list_avg(list_transform({E}, lambda x: ln(greatest(abs(x), 1e-12)))), 6) AS log_mean, round(sqrt(list_dot_product({E}, {E})), 6) AS norm,
round(list_sum({E}[1:32]) + list_sum({E}[33:64]), 6) AS sink_sum, round(1 / (1 + exp(-(list_sum({E}) - 0.5))), 6) AS probe,
round({E}[4] - ln(list_sum(list_transform({E}, lambda x: exp(x)))), 6) AS log_softmax FROM embeddings""")
def vector_summaries(spark, root):
    e = F.col("e")
    ones, zeros = F.transform(e, lambda x: F.lit(1.0)), F.transform(e, lambda x: F.lit(0.0))
    return vectors(spark, root).select("vec_id", *six(
        ("log_mean", A.log_mean(F.transform(e, F.abs))), ("norm", A.l2(e)), ("sink_sum", A.total(A.add(F.slice(e, 1, 32), F.slice(e, 33, 32)))),
        ("probe", A.probe(e, zeros, ones, ones, F.lit(-0.5))), ("log_softmax", A.log_softmax_at(e, F.lit(3))),
    ))


@query("laplacian_diagonal", f"""WITH c AS (SELECT vec_id, unnest(range(8)) AS i, {E} AS e FROM embeddings), m AS (SELECT vec_id, i, unnest(range(8)) AS j, e FROM c), w AS (SELECT vec_id, i, j, e[i * 8 + j + 1] AS a FROM m)
SELECT vec_id, j, round(sum(a) / (8 - j) - sum(CASE WHEN i = j THEN a ELSE 0 END), 6) AS lap FROM w GROUP BY vec_id, j""")
def laplacian_diagonal(spark, root):
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("e", i * 8 + 1, 8))
    return vectors(spark, root).select("vec_id", F.posexplode(A.laplacian_diagonal(grid)).alias("j", "lap")).select("vec_id", F.col("j").cast("long").alias("j"), F.round("lap", 6).alias("lap"))


@query("layer_stats", f"WITH x AS (SELECT label, unnest({E}) AS v, unnest(range(64)) AS dim FROM embeddings) SELECT label, dim, round(avg(v), 6) AS mu, round(stddev_pop(v) + 1e-6, 6) AS sigma FROM x GROUP BY label, dim")
def layer_stats(spark, root):
    stats = frames.dimension_stats(vectors(spark, root), ["label"], "e")
    return stats.select("label", F.col("dim").cast("long").alias("dim"), F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query("zscore_bucket_mean", f"""WITH x AS (SELECT vec_id, label, unnest({E}) AS v, unnest(range(64)) AS dim FROM embeddings), s AS (SELECT label, dim, avg(v) AS mu, stddev_pop(v) + 1e-6 AS sd FROM x GROUP BY ALL)
SELECT vec_id, CAST(dim % 16 AS BIGINT) AS dim, round(avg((v - mu) / sd), 5) AS z FROM x JOIN s USING (label, dim) GROUP BY vec_id, dim % 16""")
def zscore_bucket_mean(spark, root):
    stats = mean_and_deviation(vectors(spark, root), ["label"], "e", 1e-6)
    z = vectors(spark, root).join(stats, "label").select("vec_id", A.zscore(F.col("e"), F.col("mu"), F.col("sigma")).alias("z"))
    pieces = [F.slice("z", i * 16 + 1, 16) for i in range(4)]
    mean = F.transform(A.add(A.add(pieces[0], pieces[1]), A.add(pieces[2], pieces[3])), lambda v: v / 4)
    return z.select("vec_id", F.posexplode(mean).alias("dim", "z")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("z", 5).alias("z"))


@query("text_normalise", r"""SELECT item_id, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS plain, replace(text, '"', '''') AS quoted FROM benchmark""")
def text_normalise(spark, root):
    return table(spark, root, "benchmark").select("item_id", T.norm(F.col("text")).alias("plain"), T.norm_quotes(F.col("text")).alias("quoted"))


@query("json_extract", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_extract(spark, root):
    k = F.from_json(T.first_object(F.col("props")), "k long")["k"]
    return table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("missing_keys_any_layer", "WITH r AS (SELECT o_orderkey AS k, unnest(range(1, 4)) AS line FROM orders) SELECT DISTINCT k FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = line)")
def missing_keys_any_layer(spark, root):
    need = table(spark, root, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line"))
    have = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"))
    return rel.missing_anywhere(need, have, ["k"], "line")


@query("hardest_candidate", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag <> 'N' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC NULLS LAST, l_linenumber) = 1")
def hardest_candidate(spark, root):
    rows = table(spark, root, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rel.argmax(rows, ["l_orderkey"], "l_extendedprice", "l_linenumber", ["l_linenumber", "l_extendedprice"])


@query("candidate_pool_dedupe", "SELECT lower(trim(p_brand)) AS norm, arg_min(p_brand, p_partkey) AS candidate, min(p_partkey) AS pos FROM part GROUP BY 1")
def candidate_pool_dedupe(spark, root):
    rows = table(spark, root, "part").select(T.norm(F.col("p_brand")).alias("norm"), F.col("p_brand").alias("candidate"), F.col("p_partkey").alias("pos"))
    return rows.groupBy("norm").agg(F.min_by("candidate", "pos").alias("candidate"), F.min("pos").alias("pos"))


@query("resume_pending", "SELECT count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def resume_pending(spark, root):
    events = table(spark, root, "events")
    return rel.pending(events, events.where("event_type = 'purchase'"), ["user_id"]).agg(F.count("*").alias("n"))


@query("shard_slice", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events) WHERE rn % 4 = 1")
def shard_slice(spark, root):
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, root, "events").select("event_id", rn.alias("rn")).where("rn % 4 = 1").select("event_id")


@query("tolerance_validation", """WITH a AS (SELECT l_returnflag AS f, l_linestatus AS s, avg(l_discount) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag AS f, l_linestatus AS s, avg(l_discount) FILTER (l_quantity > 25) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT coalesce(a.f, b.f) AS f, coalesce(a.s, b.s) AS s, CASE WHEN b.f IS NULL THEN 'only_left' WHEN a.f IS NULL THEN 'only_right' WHEN abs(a.v - b.v) > 5e-4 THEN 'differs' ELSE 'same' END AS status FROM a FULL JOIN b ON a.f = b.f AND a.s = b.s""")
def tolerance_validation(spark, root):
    rows = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_discount", "l_quantity")
    a = rows.groupBy("f", "s").agg(F.avg("l_discount").alias("v"))
    b = rows.where("s = 'F'").groupBy("f", "s").agg(F.avg(F.when(F.col("l_quantity") > 25, F.col("l_discount"))).alias("v"))
    return rel.compare_tables(a, b, ["f", "s"], "v").select("f", "s", "status")


@query("distractor_statistics", "SELECT l_orderkey, round(avg(l_extendedprice), 6) AS mean, max(l_extendedprice) AS most, round(var_pop(l_discount), 6) AS spread, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS beaten, round(sum(l_extendedprice) / greatest(count(*), 1), 6) AS normalised FROM lineitem GROUP BY l_orderkey")
def distractor_statistics(spark, root):
    return table(spark, root, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.max("l_extendedprice").alias("most"), F.round(F.var_pop("l_discount"), 6).alias("spread"),
        F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("beaten"), F.round(A.length_normalised(F.sum("l_extendedprice"), F.count("*")), 6).alias("normalised"),
    )


SIM = """turns AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10), pairs AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) AS sim FROM turns a JOIN turns b USING (conv_id))"""


@query("uncertainty_measures", f"""WITH {SIM}, r AS (SELECT conv_id, i, avg(sim) FILTER (i <> j) AS others, ln(sum(exp(sim))) AS lse, sum(sim) AS total FROM pairs GROUP BY ALL)
SELECT conv_id, round(1 - avg(others), 6) AS luq, round(1 - sum(total) / (count(*) * count(*)), 6) AS degree, round(-avg(lse), 6) AS snne FROM r GROUP BY conv_id""")
def uncertainty_measures(spark, root):
    turns = table(spark, root, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    pairs = gen.answer_pairs(gen.first_answers(turns, "conv_id", "turn"), "conv_id", "w")
    sims = pairs.withColumn("sim", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))
    return gen.weighted_measures(sims, "conv_id", "sim").select("conv_id", *six(*[(c, F.col(c)) for c in ("luq", "degree", "snne")]))
