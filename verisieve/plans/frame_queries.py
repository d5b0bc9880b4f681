"""Queries on joins by id, sets of keys, guards, totals and the shaping of result tables."""

from pyspark.sql import functions as F

from verisieve.functions import text as X
from verisieve.operators import frames, ranks
from verisieve.operators import relational as rel
from verisieve.plans.rank_queries import EX, METHODS, OVR, auroc_sql, dim, dim_sql, examples, long_scores, rounded
from verisieve.plans.registry import query
from verisieve.plans.vector_queries import E, vectors
from verisieve.sources.tables import table

#: Documents with the category of their labels, "?" without.
ALL = f"{EX}, every AS (SELECT d.doc_id AS id, d.lang AS pair, coalesce(e.category, '?') AS category, e.id IS NOT NULL AS matched, CAST(d.n_chars AS DOUBLE) AS score FROM documents d LEFT JOIN example e ON e.id = d.doc_id)"


def everything(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("pair"), F.col("n_chars").cast("double").alias("score"))
    return frames.attach(docs, examples(spark, root).select("id", "category"), ["id"], {"category": "?"})


@query("common_ids", "SELECT d.doc_id AS id, d.lang, l.quality, CAST(e.label AS INTEGER) AS label FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id")
def common_ids(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "lang")
    labels = table(spark, root, "labels").select(F.col("doc_id").alias("id"), "quality")
    vecs = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))
    return frames.common_rows([docs, labels, vecs], ["id"])


@query("lookup_with_default", f"WITH {ALL} SELECT pair, category, count(*) AS n, count(*) FILTER (matched) AS n_matched FROM every GROUP BY ALL")
def lookup_with_default(spark, root):
    return everything(spark, root).groupBy("pair", "category").agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"))


@query("one_vs_rest_unknown", f"""WITH {ALL}, {dim_sql([*OVR, *[(f'{c}vR', '?', 0, int(c[0] == 'C')) for c in ('IH', 'IL', 'CH', 'CL')]])}, s AS (SELECT e.pair, d.contrast, d.flip, d.role AS y, e.score FROM every e JOIN dim d USING (category)), {auroc_sql('s', ['pair', 'contrast', 'flip'])}
SELECT pair, contrast, n, n_pos, round(CASE WHEN flip = 1 THEN 1 - auroc ELSE auroc END, 6) AS auroc FROM a""")
def one_vs_rest_unknown(spark, root):
    """Rows without a category are negatives of every contrast."""
    rows = [*OVR, *[(f"{c}vR", "?", 0, int(c[0] == "C")) for c in ("IH", "IL", "CH", "CL")]]
    return rounded(ranks.contrasts(everything(spark, root), dim(spark, rows), ["pair"]), "auroc")


@query("short_codes", "SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'E' WHEN 'de' THEN 'D' ELSE '?' END AS code FROM documents")
def short_codes(spark, root):
    return table(spark, root, "documents").select(F.col("doc_id").alias("id"), X.short_code(F.col("lang"), {"en": "E", "de": "D"}).alias("code"))


@query("attached_scores", f"WITH {EX} SELECT d.doc_id AS id, CASE WHEN e.id % 3 > 0 THEN e.length END AS length, e.spaces, e.residue FROM documents d LEFT JOIN example e ON e.id = d.doc_id")
def attached_scores(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"))
    scores = long_scores(spark, root).where("method <> 'length' OR id % 3 > 0")
    return frames.attach_scores(docs, scores, ["id"], list(METHODS))


@query("restricted_ids", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def restricted_ids(spark, root):
    return frames.restricted(table(spark, root, "documents").select(F.col("doc_id").alias("id")), table(spark, root, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), ["id"])


@query("pair_grid", """WITH m AS (SELECT r_name AS m, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region), d AS (SELECT s AS d, row_number() OVER (ORDER BY s) - 1 AS j FROM (SELECT DISTINCT c_mktsegment AS s FROM customer))
SELECT m || '_' || d AS pair, m AS model, d AS dataset, CAST(i * (SELECT count(*) FROM d) + j AS INTEGER) AS ord FROM m, d WHERE NOT (i = 0 AND j = 1)""")
def pair_grid(spark, root):
    """Regions stand in for models, market segments for datasets; one pair is left out."""
    models, datasets = frames.names_of(table(spark, root, "region"), "r_name"), frames.names_of(table(spark, root, "customer"), "c_mktsegment")
    only = [f"{m}_{d}" for i, m in enumerate(models) for j, d in enumerate(datasets) if (i, j) != (0, 1)]
    return frames.grid(spark, models, datasets, only).select("pair", "model", "dataset", "ord")


@query("key_sets", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings) UNION ALL SELECT 'left', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings)")
def key_sets(spark, root):
    a, b = table(spark, root, "documents").select(F.col("doc_id").alias("id")), table(spark, root, "embeddings").select(F.col("vec_id").alias("id"))
    parts = {"both": frames.key_intersection(a, b, ["id"]), "either": frames.key_union([a, b], ["id"]), "left": frames.key_difference(a, b, ["id"])}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("best_column", f"WITH {EX} SELECT id, CASE WHEN greatest(residue, spaces, length / 10) = residue THEN 'residue' WHEN spaces >= length / 10 THEN 'spaces' ELSE 'tenth' END AS best, round(greatest(residue, spaces, length / 10), 6) AS value FROM example")
def best_column(spark, root):
    rows = examples(spark, root).withColumn("tenth", F.col("length") / 10).withColumn("none", F.lit(float("nan")))
    return frames.argmax_columns(rows, ["none", "residue", "spaces", "tenth"]).select("id", "best", F.round("value", 6).alias("value"))


@query("method_means", f"""WITH {EX}, {auroc_sql('long', ['pair', 'method'])} SELECT method, round(avg(auroc), 6) AS auroc, count(*) AS n_pairs FROM a GROUP BY method""")
def method_means(spark, root):
    a = ranks.auroc(long_scores(spark, root), ["pair", "method"])
    noted = a.withColumn("method", F.concat("method", F.lit(" (best="), "pair", F.lit(")"))).withColumn("auroc", F.coalesce("auroc", F.lit(float("nan"))))
    return rounded(frames.method_means(noted, ["auroc"]), "auroc")


@query("rounded_means", f"WITH {EX} SELECT method, hi, round(avg(score), 4) AS score FROM long GROUP BY method, hi")
def rounded_means(spark, root):
    return frames.rounded_means(long_scores(spark, root), ["method", "hi"], ["score"])


@query("ordered_results", f"""WITH {EX}, {auroc_sql('long', ['pair', 'method'])}, o AS (SELECT pair, method, row_number() OVER (ORDER BY CASE pair WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 99 END, pair, method) AS place FROM a) SELECT * FROM o""")
def ordered_results(spark, root):
    return frames.placed_results(ranks.auroc(long_scores(spark, root), ["pair", "method"]), ["fr", "de"]).select("pair", "method", "place")


@query("row_filters", """SELECT conv_id AS id, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY conv_id HAVING count(*) >= 3 AND min(role) <> 'system'""")
def row_filters(spark, root):
    turns = frames.usable_rows(table(spark, root, "conversations"), text="text")
    rows = turns.groupBy(F.col("conv_id").alias("id")).agg(F.collect_list("text").alias("answers"), F.when(F.min("role") != "system", F.min("role")).otherwise("?").alias("category"))
    return frames.usable_rows(rows, answers="answers", category="category", least=3).select("id", F.size("answers").cast("long").alias("n"))


@query("size_guards", f"""WITH {EX}, {auroc_sql('long', ['pair', 'method', 'hi'])}, c AS (SELECT pair, hi, count(*) AS n_train FROM example GROUP BY ALL)
SELECT a.pair, method, a.hi, round(CASE WHEN n_train >= 30 AND a.n >= 20 AND n_pos >= 5 THEN auroc END, 6) AS auroc FROM a JOIN c ON a.pair = c.pair AND a.hi = c.hi""")
def size_guards(spark, root):
    ex = examples(spark, root)
    rows = ranks.auroc(long_scores(spark, root), ["pair", "method", "hi"]).join(ex.groupBy("pair", "hi").agg(F.count("*").alias("n_train")), ["pair", "hi"])
    return rounded(frames.enough(rows, {"n_train": "train_ids", "n": "test_ids", "n_pos": "band"}, ["auroc"]), "auroc").select("pair", "method", "hi", "auroc")


@query("pooled_verdict", """WITH m AS (SELECT avg(l_discount) FILTER (l_returnflag = 'A') - avg(l_discount) FILTER (l_returnflag = 'R') AS d, avg(l_tax) FILTER (l_returnflag = 'A') - avg(l_tax) FILTER (l_returnflag = 'R') AS t, avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'R') AS q FROM lineitem)
SELECT round(d, 6) AS d, round(t, 6) AS t, round(q, 6) AS q, (d > 0 OR q > 0) AND t >= -0.01 AS passed FROM m""")
def pooled_verdict(spark, root):
    means = table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"))
    return rounded(frames.pooled_verdict(means, "A", "R", ["d", "q"], ["t"]), "d", "t", "q")


@query("complete_rows", "SELECT doc_id AS id FROM documents WHERE text IS NOT NULL AND lang <> 'en'")
def complete_rows(spark, root):
    rows = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("lang") != "en", F.col("lang")).alias("greedy"))
    return frames.complete_rows(rows, ["text", "greedy"]).select("id")


@query("interleaved_shard", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events) WHERE rn % 4 = 1")
def interleaved_shard(spark, root):
    return frames.shard(table(spark, root, "events").select("event_id", "ts"), ["ts", "event_id"], 1, 4).select("event_id")


@query("trial_head", "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 25")
def trial_head(spark, root):
    return frames.head(table(spark, root, "events").select("event_id", "value"), [F.desc("value"), F.asc("event_id")], 25).select("event_id")


@query("sized_sample", f"WITH {EX}, c AS (SELECT id, CASE WHEN category <> 'CL' THEN category END AS cat FROM example), k AS (SELECT count(DISTINCT cat) + max(CASE WHEN cat IS NULL THEN 1 ELSE 0 END) AS k FROM c) SELECT id, cat FROM c, k WHERE cat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cat ORDER BY md5('7|' || id), id) <= 40 // max(k) OVER ()")
def sized_sample(spark, root):
    rows = examples(spark, root).select("id", F.when(F.col("category") != "CL", F.col("category")).alias("cat"))
    return frames.sized_sample(rows, "cat", "id", 40, "7")


@query("least_length", "SELECT role, min(len(string_split(text, ' '))) AS least FROM conversations GROUP BY role")
def least_length(spark, root):
    rows = table(spark, root, "conversations").select("role", F.split("text", " ").alias("w"))
    return frames.least_length(rows, ["role"], "w").select("role", F.col("least").cast("long").alias("least"))


@query("vector_sanity", f"WITH x AS (SELECT label, unnest({E}) AS v FROM embeddings) SELECT label, true AS finite, min(v) = max(v) AS constant, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM x GROUP BY label")
def vector_sanity(spark, root):
    return rounded(frames.sanity(vectors(spark, root), ["label"], "e"), "least", "most", "mean", "deviation")


@query("first_seen", "SELECT source, min(doc_id) AS seen_at FROM documents GROUP BY source")
def first_seen(spark, root):
    return frames.first_seen(table(spark, root, "documents").select("doc_id", "source"), "source", "doc_id")


@query("config_merge", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'y' END AS more FROM customer")
def config_merge(spark, root):
    old = table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name").alias("m"))
    new = old.where("k % 3 = 0").select("k", F.create_map(F.lit("segment"), F.lit("new"), F.lit("more"), F.lit("y")).alias("m"))
    m = frames.merged(old, new, "k", "m")
    return m.select("k", *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("segment", "name", "more")])


@query("discoveries", f"""WITH {EX}, p AS (SELECT id, pair, (residue + 1) / 980.0 AS p FROM example), k AS (SELECT *, p * count(*) OVER (PARTITION BY pair) / row_number() OVER (PARTITION BY pair ORDER BY p, id) AS q0 FROM p),
q AS (SELECT pair, least(1, min(q0) OVER (PARTITION BY pair ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k) SELECT pair, count(*) AS n, count(*) FILTER (q < 0.05) AS below, round(avg(CASE WHEN q < 0.05 THEN 1.0 ELSE 0 END), 6) AS share FROM q GROUP BY pair""")
def discoveries(spark, root):
    p = examples(spark, root).select("id", "pair", ((F.col("residue") + 1) / 980.0).alias("p"))
    return rounded(ranks.discoveries(ranks.benjamini_hochberg(p, ["pair"], "p", "id"), ["pair"]), "share")


@query("answer_flags", "SELECT p_partkey AS id, lower(trim(p_brand)) = lower(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_brand) ELSE p_type END)) AS is_gt, lower(p_brand) = lower(p_name) AS is_greedy FROM part")
def answer_flags(spark, root):
    truth = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_brand"))).otherwise(F.col("p_type"))
    return table(spark, root, "part").select(F.col("p_partkey").alias("id"), X.same_answer(F.col("p_brand"), truth).alias("is_gt"), X.same_answer(F.col("p_brand"), F.col("p_name")).alias("is_greedy"))
