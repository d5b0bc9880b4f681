"""Queries on attention matrices, layers of states, logits, entailment and the neural interfaces.

Embeddings stand in: 64 numbers cut as matrices, as layers x heads x positions, or as logits.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verisieve.functions import arrays as A
from verisieve.operators import boundary, frames
from verisieve.operators import generations as gen
from verisieve.operators.vectors import mean_and_deviation
from verisieve.plans.registry import query
from verisieve.plans.source_queries import scratch
from verisieve.plans.vector_queries import E, six, vectors
from verisieve.sources import readers, sinks
from verisieve.sources.tables import table


def blocks(col, n, width):
    """``n`` consecutive pieces of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(col, i * width + 1, width))


def rounded(a, places=6):
    return F.transform(a, lambda v: A.rounded(v, places))


@query("attention_diagonal", f"SELECT vec_id, list_transform(range(8), lambda i: round({E}[i * 9 + 1], 6)) AS diag FROM embeddings")
def attention_diagonal(spark, root):
    return vectors(spark, root).select("vec_id", rounded(A.matrix_diagonal(blocks("e", 8, 8))).alias("diag"))


@query("layer_laplacians", f"""WITH c AS (SELECT vec_id, {E} AS e, unnest(range(4)) AS layer FROM embeddings), m AS (SELECT *, unnest(range(4)) AS j FROM c), w AS (SELECT *, CASE WHEN layer = 0 THEN 0 ELSE 1 END AS up FROM m)
SELECT vec_id, CAST(layer AS INTEGER) AS layer, CAST(j AS INTEGER) AS j, round((e[layer * 16 + j + 1] + e[layer * 16 + 4 + j + 1] + e[layer * 16 + 8 + j + 1] + e[layer * 16 + 12 + j + 1] + 0.5 * up) / (4 - j + up) - e[layer * 16 + j * 5 + 1], 6) AS lap FROM w""")
def layer_laplacians(spark, root):
    stack = F.transform(blocks("e", 4, 16), lambda m: blocks(m, 4, 4))
    rows = vectors(spark, root).select("vec_id", F.posexplode(A.layer_laplacians(stack, 0.5)).alias("layer", "l"))
    return rows.select("vec_id", "layer", F.posexplode("l").alias("j", "lap")).select("vec_id", "layer", "j", F.round("lap", 6).alias("lap"))


@query("spectral_features", f"""WITH c AS (SELECT vec_id, {E} AS e, unnest(range(16)) AS cell FROM embeddings), t AS (SELECT vec_id, cell, list_sort(e[cell * 4 + 1:cell * 4 + 4], 'DESC')[1:2] AS top FROM c)
SELECT vec_id, list_transform(flatten(list(top ORDER BY cell)), lambda v: round(v, 6)) AS x, list_transform(flatten(list(top ORDER BY cell) FILTER (cell // 4 = 2)), lambda v: round(v, 6)) AS one FROM t GROUP BY vec_id""")
def spectral_features(spark, root):
    """Top values of every layer and head, in their order; and of one layer."""
    cells = vectors(spark, root).select("vec_id", F.posexplode(blocks("e", 16, 4)).alias("cell", "d"))
    top = cells.select("vec_id", (F.col("cell") / 4).cast("int").alias("layer"), (F.col("cell") % 4).alias("head"), A.top_values(F.col("d"), 2).alias("top"))
    every = frames.listed(top, ["vec_id"], ["layer", "head"], "top")
    one = frames.listed(top.where("layer = 2"), ["vec_id"], ["layer", "head"], "top", "one")
    return every.join(one, "vec_id").select("vec_id", rounded(F.col("x")).alias("x"), rounded(F.col("one")).alias("one"))


@query("cell_means", f"SELECT vec_id, round(list_avg(list_sort({E}[1:32], 'DESC')[1:5]), 6) AS first, round(list_avg({E}[1:3]), 6) AS short FROM embeddings")
def cell_means(spark, root):
    return vectors(spark, root).select("vec_id", *six(("first", A.mean_top(F.slice("e", 1, 32))), ("short", A.mean_top(F.slice("e", 1, 3)))))


@query("bucket_vectors", f"""WITH x AS (SELECT vec_id, unnest({E}) AS v, unnest(range(64)) AS i FROM embeddings), s AS (SELECT i, avg(v) AS mu, stddev_pop(v) + 1e-6 AS sd FROM x GROUP BY i), z AS (SELECT vec_id, i // 16 AS layer, i % 16 AS dim, (v - mu) / sd AS z FROM x JOIN s USING (i)),
b AS (SELECT vec_id, dim, CASE WHEN layer < 2 THEN 0 ELSE 1 END AS bucket, avg(z) AS z FROM z GROUP BY ALL)
SELECT vec_id, list_concat(list(round(z, 5) ORDER BY bucket, dim), [round(vec_id / 7.0, 5)]) AS x FROM b GROUP BY vec_id""")
def bucket_vectors(spark, root):
    states = vectors(spark, root).select("vec_id", (F.col("vec_id") / 7.0).alias("lp"), F.posexplode(blocks("e", 4, 16)).alias("layer", "vector"))
    stats = mean_and_deviation(states, ["layer"], "vector", 1e-6)
    return frames.bucket_vector(states, stats, {"mid": [0, 1], "late": [2, 3]}, ["vec_id"], "lp").select("vec_id", rounded(F.col("x"), 5).alias("x"))


@query("late_vector_mean", f"WITH x AS (SELECT vec_id, unnest({E}[33:64]) AS v, unnest(range(32)) % 16 AS dim FROM embeddings), m AS (SELECT vec_id, dim, avg(v) AS v FROM x GROUP BY ALL) SELECT vec_id, list(round(v, 6) ORDER BY dim) AS mean FROM m GROUP BY vec_id")
def late_vector_mean(spark, root):
    states = vectors(spark, root).select("vec_id", F.posexplode(blocks("e", 4, 16)).alias("layer", "vector"))
    return frames.vector_mean(states.where("layer >= 2"), ["vec_id"], "vector").select("vec_id", rounded(F.col("mean")).alias("mean"))


@query("answer_log_prob", f"""WITH c AS (SELECT vec_id, {E} AS e, unnest(range(4)) AS pos FROM embeddings), l AS (SELECT vec_id, pos, e[pos * 16 + (vec_id + pos) % 16 + 1] - ln(list_sum(list_transform(e[pos * 16 + 1:pos * 16 + 16], lambda v: exp(v)))) AS lp FROM c)
SELECT vec_id, round(sum(lp), 6) AS total, round(sum(lp) FILTER (pos < 2) / 2, 6) AS low, round(sum(lp) FILTER (pos >= 2) / 2, 6) AS high FROM l GROUP BY vec_id""")
def answer_log_prob(spark, root):
    """Summed over four positions; and as two layers of two positions each."""
    target = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("vec_id") + i) % 16).cast("int"))
    logits = blocks("e", 4, 16)
    layers = [A.lens_scores(F.array(F.slice(logits, at, 2)), F.slice(target, at, 2))[0] for at in (1, 3)]
    return vectors(spark, root).select("vec_id", *six(("total", A.answer_log_prob(logits, target)), ("low", layers[0]), ("high", layers[1])))


@query("half_bundle", "SELECT vec_id, CAST(label AS INTEGER) AS layer, [CAST(vec_id % 4 AS DOUBLE), -0.5] AS vector FROM embeddings WHERE label >= 5")
def half_bundle(spark, root):
    """Tensors stored as 16-bit patterns."""
    bits = F.array(F.lit(0), F.lit(15360), F.lit(16384), F.lit(16896))  # 0, 1, 2 and 3
    pattern = F.array(F.element_at(bits, (F.col("vec_id") % 4 + 1).cast("int")), F.lit(47104)).cast("array<int>")
    path = scratch(spark)
    sinks.write_bundle(vectors(spark, root).where("label IS NOT NULL").select("vec_id", F.col("label").alias("layer"), pattern.alias("vector")), path, ["vec_id"])
    return readers.read_bundle(spark, path, ["vector"], 5).select("vec_id", "layer", F.col("vector").cast("array<double>").alias("vector"))


@query("candidate_map", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS candidate FROM part WHERE p_partkey % 3 > 0")
def candidate_map(spark, root):
    path = scratch(spark)
    rows = table(spark, root, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("candidate"), F.lit(1).alias("more"))
    sinks.write_json(rows, path)
    return readers.read_candidate_map(spark, path)


@query("split_file", "SELECT 'train::' || item_id AS id, 'train' AS source_split, CAST(item_id AS BIGINT) AS number FROM benchmark")
def split_file(spark, root):
    path = scratch(spark)
    sinks.write_split(table(spark, root, "benchmark").select(F.concat(F.lit("train::"), F.col("item_id").cast("string")).alias("id")), path)
    return readers.read_split(spark, path)


@query("copied_or_sampled", "SELECT 'small' AS part, count(*) AS n FROM nation UNION ALL SELECT 'large', count(*) FROM customer WHERE c_custkey % 2 = 0")
def copied_or_sampled(spark, root):
    small = sinks.copy_small(table(spark, root, "nation").select("n_nationkey"), scratch(spark), 25, lambda df: df.where("false"))
    large = sinks.copy_small(table(spark, root, "customer").select("c_custkey"), scratch(spark), 25, lambda df: df.where("c_custkey % 2 = 0"))
    return small.agg(F.count("*").alias("n")).select(F.lit("small").alias("part"), "n").unionByName(large.agg(F.count("*").alias("n")).select(F.lit("large").alias("part"), "n"))


def lengths_model(a: pd.Series, b: pd.Series) -> pd.Series:
    """A stand-in for an entailment model: logits from the two lengths."""
    x, y = a.str.len(), b.str.len()
    return pd.Series([[float(i % 3), float(j % 2), float((i + j) % 4)] for i, j in zip(x, y)])


LOGITS = """turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(conv_id || ' ' || coalesce(text, '')) AS n FROM conversations QUALIFY i < 10),
p AS (SELECT a.conv_id, a.i AS i, b.i AS j, exp(a.n % 3) AS c, exp(b.n % 2) AS u, exp((a.n + b.n) % 4) AS e, CASE WHEN a.n % 3 >= greatest(b.n % 2, (a.n + b.n) % 4) THEN 0 WHEN b.n % 2 >= (a.n + b.n) % 4 THEN 1 ELSE 2 END AS k FROM turns a JOIN turns b USING (conv_id))"""


def entailments(spark, root):
    turns = table(spark, root, "conversations").select("conv_id", "turn", F.col("conv_id").cast("string").alias("q"), F.coalesce("text", F.lit("")).alias("a"))
    return gen.entailment_pairs(gen.first_answers(turns, "conv_id", "turn"), "conv_id", "q", "a", lengths_model)


@query("entailment_variants", f"WITH {LOGITS} SELECT conv_id, round(avg(e / (c + u + e)), 6) AS strict, round(avg(e / (e + c)), 6) AS luq, round(avg((e + 0.5 * u) / (c + u + e)), 6) AS weighted FROM p GROUP BY conv_id")
def entailment_variants(spark, root):
    p = entailments(spark, root)
    return p.groupBy("conv_id").agg(*six(*[(v, F.avg(gen.entailment_score(F.col("p"), v))) for v in ("strict", "luq", "weighted")]))


@query("equivalent_answers", f"WITH {LOGITS} SELECT a.conv_id, count(*) FILTER (a.k <> 0 AND b.k <> 0 AND NOT (a.k = 1 AND b.k = 1)) AS loose, count(*) FILTER (a.k = 2 AND b.k = 2) AS strict FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.i = b.j AND a.j = b.i GROUP BY a.conv_id")
def equivalent_answers(spark, root):
    p = entailments(spark, root)
    loose, strict = (gen.equivalent_answers(p, "conv_id", s).groupBy("conv_id").agg(F.count_if("same").alias(n)) for s, n in ((False, "loose"), (True, "strict")))
    return loose.join(strict, "conv_id")


@query("entailment_clusters", f"""WITH RECURSIVE {LOGITS}, s AS (SELECT a.conv_id, a.i, a.j FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.i = b.j AND a.j = b.i WHERE a.k <> 0 AND b.k <> 0 AND NOT (a.k = 1 AND b.k = 1)),
w(conv_id, i, starters, cluster) AS (SELECT conv_id, 0::BIGINT, [0::BIGINT], 0::BIGINT FROM turns WHERE i = 0
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.c IS NULL THEN list_append(w.starters, t.i) ELSE w.starters END, coalesce(f.c, t.i)
  FROM w JOIN turns t ON t.conv_id = w.conv_id AND t.i = w.i + 1, LATERAL (SELECT min(s.i) AS c FROM s WHERE s.conv_id = t.conv_id AND s.j = t.i AND list_contains(w.starters, s.i)) f)
SELECT conv_id, CAST(i AS INTEGER) AS i, CAST(cluster AS INTEGER) AS cluster FROM w""")
def entailment_clusters(spark, root):
    same = gen.equivalent_answers(entailments(spark, root), "conv_id")
    return gen.semantic_clusters(same, "conv_id", "same")


MEASURED = f"""{LOGITS}, s AS (SELECT a.conv_id, a.i, a.j FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.i = b.j AND a.j = b.i WHERE a.k <> 0 AND b.k <> 0 AND NOT (a.k = 1 AND b.k = 1)),
w(conv_id, i, starters) AS (SELECT conv_id, 0::BIGINT, [0::BIGINT] FROM turns WHERE i = 0
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.c IS NULL THEN list_append(w.starters, t.i) ELSE w.starters END
  FROM w JOIN turns t ON t.conv_id = w.conv_id AND t.i = w.i + 1, LATERAL (SELECT min(s.i) AS c FROM s WHERE s.conv_id = t.conv_id AND s.j = t.i AND list_contains(w.starters, s.i)) f),
sets AS (SELECT conv_id, CAST(max(len(starters)) AS DOUBLE) AS num_set FROM w GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT conv_id, i, sum(e / (c + u + e)) AS t, ln(sum(exp(e / (c + u + e)))) AS l, avg(e / (e + c)) FILTER (i <> j) AS o FROM p GROUP BY 1, 2),
m AS (SELECT conv_id, any_value(num_set) AS num_set, 1 - sum(t) / (count(*) * count(*)) AS degree, 1 - avg(o) AS luq, -avg(l) AS snne FROM r JOIN sets USING (conv_id) GROUP BY 1)"""
TOLD = ("num_set", "degree", "luq", "snne")


def records(spark, root):
    turns = table(spark, root, "conversations").where("conv_id IS NOT NULL").select("conv_id", "turn", F.col("conv_id").cast("string").alias("q"), F.coalesce("text", F.lit("")).alias("a"))
    return gen.uncertainty_records(gen.first_answers(turns, "conv_id", "turn"), "conv_id", "q", "a", lengths_model)


@query("uncertainty_scores", f"WITH RECURSIVE {MEASURED} SELECT conv_id, num_set, round(degree, 6) AS degree, round(luq, 6) AS luq, round(snne, 6) AS snne FROM m")
def uncertainty_scores(spark, root):
    """The measures of a question that SQL can express."""
    return records(spark, root).select("conv_id", "num_set", *six(*[(c, F.col(c)) for c in TOLD[1:]]))


@query("uncertainty_record")
def uncertainty_record(spark, root):
    """All seven measures of a question."""
    return records(spark, root).select("conv_id", *[F.round(c, 5).alias(c) for c in gen.MEASURES])


@query("measure_table", f"""WITH RECURSIVE {MEASURED}, x AS (SELECT conv_id, CAST(conv_id % 2 AS INTEGER) AS pair, CASE WHEN conv_id % 3 > 0 THEN 1 ELSE 0 END AS good, num_set, round(degree, 6) AS degree, round(luq, 6) AS luq, round(snne, 6) AS snne FROM m),
n AS (UNPIVOT x ON num_set, degree, luq, snne INTO NAME method VALUE u),
k AS (SELECT *, rank() OVER (PARTITION BY pair, method ORDER BY u) + (count(*) OVER (PARTITION BY pair, method, u) - 1) / 2.0 AS rk, avg(good) OVER (PARTITION BY pair, method ORDER BY u, conv_id ROWS UNBOUNDED PRECEDING) AS acc FROM n),
t0 AS (SELECT pair, method, u, sum(good) AS g, count(*) AS c FROM n GROUP BY pair, method, u), t AS (SELECT *, sum(g) OVER v / sum(c) OVER v AS prec FROM t0 WINDOW v AS (PARTITION BY pair, method ORDER BY u)),
y AS (SELECT pair, method, sum(g * prec) / sum(g) AS aucpr FROM t GROUP BY ALL)
SELECT pair, method, round((sum(rk) FILTER (good = 0) - count(*) FILTER (good = 0) * (count(*) FILTER (good = 0) + 1) / 2.0) / (count(*) FILTER (good = 0) * count(*) FILTER (good = 1)), 6) AS auroc, round(avg(acc), 6) AS auarc, round(any_value(aucpr), 6) AS aucpr, count(*) AS n
FROM k JOIN y USING (pair, method) GROUP BY pair, method""")
def measure_table(spark, root):
    """The table of a run: pairs by parity, answers right where the id is no multiple of 3."""
    told = uncertainty_scores(spark, root).withColumns({"pair": (F.col("conv_id") % 2).cast("int"), "good": F.col("conv_id") % 3 > 0})
    out = gen.measure_table(told, ["pair"], "conv_id", "good", TOLD)
    return out.select("pair", "method", *six(*[(c, F.col(c)) for c in ("auroc", "auarc", "aucpr")]), "n")


@query("few_shot_prefixes", "SELECT n_name AS pair, CASE WHEN n_nationkey % 2 = 0 THEN 'own ' || n_nationkey ELSE 'all ' || n_regionkey END AS prefix FROM nation")
def few_shot_prefixes(spark, root):
    nations = table(spark, root, "nation")
    pairs = nations.select(F.col("n_name").alias("pair"), F.col("n_regionkey").alias("dataset"))
    own = nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("pair"), F.concat(F.lit("own "), F.col("n_nationkey").cast("string")).alias("prefix"))
    defaults = table(spark, root, "region").select(F.col("r_regionkey").alias("dataset"), F.concat(F.lit("all "), F.col("r_regionkey").cast("string")).alias("prefix"))
    return gen.prefixes(pairs, own, defaults).select("pair", "prefix")


def ids_of(spark, root):
    return vectors(spark, root).select("vec_id", "e")


def states_model(name):
    return lambda rows: [{n: np.asarray(e, float)[n * 16 : n * 16 + 16] for n in range(4)} for (e,) in rows]


@query("hidden_states", f"SELECT vec_id, CAST(layer AS INTEGER) AS layer, round(list_sum({E}[layer * 16 + 1:layer * 16 + 16]), 4) AS total FROM (SELECT vec_id, embedding, unnest([1, 3]) AS layer FROM embeddings)")
def hidden_states(spark, root):
    got = boundary.hidden_states(ids_of(spark, root), ["vec_id"], ["e"], "states", states_model, [1, 3], 64)
    return got.select("vec_id", "layer", F.round(A.total(F.col("vector")), 4).alias("total"))


def attention_model(name):
    return lambda rows: [np.asarray(e, float).reshape(2, 2, 4, 4) for (e,) in rows]


@query("attention_pass", f"""WITH c AS (SELECT vec_id, {E} AS e, unnest(range(4)) AS cell FROM embeddings), m AS (SELECT *, unnest(range(4)) AS j FROM c),
d AS (SELECT vec_id, cell, j, e[cell * 16 + j * 5 + 1] AS own, (e[cell * 16 + j + 1] + e[cell * 16 + 4 + j + 1] + e[cell * 16 + 8 + j + 1] + e[cell * 16 + 12 + j + 1]) / (4 - j) AS deg FROM m)
SELECT vec_id, CAST(cell // 2 AS INTEGER) AS layer, CAST(cell % 2 AS INTEGER) AS head, list(round(own, 6) ORDER BY j) AS attn_diag, list(round(deg - own, 6) ORDER BY j) AS lap_diag FROM d GROUP BY vec_id, cell""")
def attention_pass(spark, root):
    got = boundary.attention_diagonals(ids_of(spark, root), ["vec_id"], ["e"], "attention", attention_model, 64)
    return got.select("vec_id", "layer", "head", rounded(F.col("attn_diag")).alias("attn_diag"), rounded(F.col("lap_diag")).alias("lap_diag"))


def values_model(name):
    def run(rows):
        cut = [np.asarray(e, float).reshape(4, 4, 4) for (e,) in rows]
        return [{"layers.10.v": x[2], "layers.2.v": x[1], "vision.layers.1.v": x[3], "layers.1.v": x[0]} for x in cut]

    return run


@query("value_norm_pass", f"""WITH c AS (SELECT vec_id, {E} AS e, unnest(range(6)) AS cell FROM embeddings), m AS (SELECT vec_id, cell, e, unnest(range(4)) AS pos FROM c)
SELECT vec_id, CAST(cell // 2 AS INTEGER) AS layer, CAST(cell % 2 AS INTEGER) AS kv_head, list(round(sqrt(e[cell // 2 * 16 + pos * 4 + cell % 2 * 2 + 1] ** 2 + e[cell // 2 * 16 + pos * 4 + cell % 2 * 2 + 2] ** 2), 6) ORDER BY pos) AS vnorm FROM m GROUP BY vec_id, cell""")
def value_norm_pass(spark, root):
    got = boundary.value_norms(ids_of(spark, root), ["vec_id"], ["e"], "values", values_model, 2, batch=64)
    return got.select("vec_id", "layer", "kv_head", rounded(F.col("vnorm")).alias("vnorm"))


def records_model(name):
    return lambda rows: [(np.asarray(e, float).reshape(4, 16)[:, : i % 3], {15: float(e[0]), 5: float(e[1])}) for i, e in rows]


@query("answer_sidecars", f"""SELECT vec_id, CAST(vec_id % 3 AS INTEGER) AS n, round(list_sum({E}[49:48 + vec_id % 3]) / (vec_id % 3), 6) AS last, round({E}[1], 6) AS probe FROM embeddings WHERE vec_id % 3 > 0""")
def answer_sidecars(spark, root):
    got = boundary.answer_sidecars(ids_of(spark, root), ["vec_id"], ["vec_id", "e"], "records", records_model, batch=64)
    return got.select("vec_id", F.col("n_answer_tokens").alias("n"), *six(("last", F.col("s_ext_l")[3]), ("probe", F.col("s_int")[15])))
