"""Queries on fitted models and answer measures; none of these has an SQL twin but where given.

Stand-ins: rows are embeddings, y tells labels of 5 and more from the others, the pair is
vec_id mod 2, the band is HI where the first component is positive.
"""

from pyspark.sql import functions as F

from verisieve.functions import arrays as A
from verisieve.operators import components, detectors, features, models, ranks
from verisieve.operators import generations as gen
from verisieve.operators import relational as rel
from verisieve.plans.registry import query
from verisieve.sources.tables import table


def examples(spark, root):
    rows = table(spark, root, "embeddings").where("label IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") >= 5).cast("int").alias("y"), (F.col("vec_id") % 2).cast("int").alias("pair"))
    rows = rows.withColumn("band", F.when(F.col("e")[0] > 0, "HI").otherwise("LO"))
    return rel.stratified_split(rows, ["pair", "y"], "vec_id", 0.3, "42")


def cut(rows):
    return rows.where("NOT is_test"), rows.where("is_test")


@query("lr_train_score_auroc")
def lr_train_score_auroc(spark, root):
    train, test = cut(examples(spark, root))
    return models.fit_score(train, test, ["pair"], "e").select("pair", "n_train", "n", "n_pos", F.round("auroc", 6).alias("auroc"))


@query("lr_scores_dump")
def lr_scores_dump(spark, root):
    train, test = cut(examples(spark, root))
    return models.predict(test, models.fit_logistic(train, ["pair"], "e", c=0.1), ["pair"], "e").select("vec_id", "pair", "y", F.round("p", 6).alias("p"))


@query("lr_cv_select")
def lr_cv_select(spark, root):
    train, _ = cut(examples(spark, root))
    grid = [(f"top_k={k}", A.top_values(F.col("e"), k)) for k in (5, 10, 25)]
    return models.select_config(train, ["pair"], "vec_id", grid, scale=False).select("pair", "config", F.round("auroc", 6).alias("auroc"))


@query("lr_pca_score")
def lr_pca_score(spark, root):
    train, test = cut(examples(spark, root))
    axes = components.fit_components(train, ["pair"], 16, "e")
    a, b = (components.project(d, axes, ["pair"], "e") for d in (train, test))
    return models.fit_score(a, b, ["pair"], "x", scale=False).select("pair", "n_train", "n", "n_pos", F.round("auroc", 6).alias("auroc"))


@query("lr_specialist_bands")
def lr_specialist_bands(spark, root):
    train, test = cut(examples(spark, root))
    special = models.fit_score(train, test, ["pair", "band"], "e", least=20).select("pair", "band", F.col("auroc").alias("specialist"), "n_train")
    general = ranks.auroc(models.predict(test, models.fit_logistic(train, ["pair"], "e"), ["pair"], "e"), ["pair", "band"], "p").select("pair", "band", F.col("auroc").alias("generalist"))
    both = special.join(general, ["pair", "band"], "left")
    return both.select("pair", "band", "n_train", *[F.round(c, 6).alias(n) for n, c in (("specialist", F.col("specialist")), ("generalist", F.col("generalist")), ("delta", F.col("specialist") - F.col("generalist")))])


@query("lr_feature_combos")
def lr_feature_combos(spark, root):
    """Combinations of named feature blocks, each concatenated to one vector."""
    blocks = {"attention": F.slice("e", 1, 16), "laplacian": F.slice("e", 17, 16), "hidden": F.slice("e", 33, 32), "sink": A.top_values(F.slice("e", 1, 32), 5), "score": F.array(A.log_mean(F.transform("e", F.abs)))}
    combos = (("attention",), ("laplacian",), ("attention", "hidden"), ("laplacian", "hidden"), ("sink",), ("sink", "hidden"), ("score", "hidden"))
    train, test = cut(examples(spark, root))
    named = {"+".join(parts): parts for parts in combos}
    return detectors.score_combinations(train, test, ["pair"], blocks, named).select("pair", "combo", F.round("auroc", 6).alias("auroc"))


@query("lr_out_of_fold")
def lr_out_of_fold(spark, root):
    rows = models.out_of_fold(examples(spark, root), ["pair"], "vec_id", "e")
    return rows.select("vec_id", "pair", "y", F.col("fold").cast("int").alias("fold"), F.round("p", 6).alias("p"))


@query("lr_hidden_subset")
def lr_hidden_subset(spark, root):
    """High against low band among the rows of y = 1."""
    train, test = (d.where("y = 1").withColumn("y2", (F.col("band") == "HI").cast("int")) for d in cut(examples(spark, root)))
    return models.fit_score(train, test, ["pair"], "e", "y2", c=0.1).select("pair", "n_train", "n", "n_pos", F.round("auroc", 6).alias("auroc"))


@query("rank_sum_p_values")
def rank_sum_p_values(spark, root):
    cells = examples(spark, root).select("pair", "y", F.posexplode("e").alias("cell", "score"))
    tested = features.rank_sum_test(cells, ["pair", "cell"])
    return ranks.benjamini_hochberg(tested, ["pair"], "p", "cell").select("pair", "cell", "u", *[F.round(c, 9).alias(c) for c in ("p", "q")])


def answers(spark, root):
    return gen.first_answers(table(spark, root, "conversations").where("conv_id IS NOT NULL").select("conv_id", "turn", "text"), "conv_id", "turn")


def overlap_pairs(spark, root):
    words = answers(spark, root).select("conv_id", "i", F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("w"))
    pairs = gen.answer_pairs(words, "conv_id", "w")
    return pairs.withColumn("sim", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")))


@query("rouge_lexical_similarity")
def rouge_lexical_similarity(spark, root):
    return gen.lexical_similarity(answers(spark, root), "conv_id", "text").select("conv_id", F.round("lexical_similarity", 6).alias("lexical_similarity"))


@query("spectral_uncertainty")
def spectral_uncertainty(spark, root):
    out = gen.spectral_measures(overlap_pairs(spark, root), "conv_id", "sim")
    return out.select("conv_id", *[F.round(c, 5).alias(c) for c in ("sum_eigv", "eccentricity")])


@query("semantic_clusters", """WITH RECURSIVE turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, list_distinct(string_split(lower(coalesce(text, '')), ' ')) AS w FROM conversations WHERE conv_id IS NOT NULL QUALIFY i < 10),
s AS (SELECT a.conv_id, a.i, b.i AS j FROM turns a JOIN turns b USING (conv_id) WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.1),
w(conv_id, i, starters, cluster) AS (SELECT conv_id, 0::BIGINT, [0::BIGINT], 0::BIGINT FROM turns WHERE i = 0
  UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.c IS NULL THEN list_append(w.starters, t.i) ELSE w.starters END, coalesce(f.c, t.i)
  FROM w JOIN turns t ON t.conv_id = w.conv_id AND t.i = w.i + 1, LATERAL (SELECT min(s.i) AS c FROM s WHERE s.conv_id = t.conv_id AND s.j = t.i AND list_contains(w.starters, s.i)) f),
z AS (SELECT conv_id, cluster, count(*) AS c FROM w GROUP BY ALL), e AS (SELECT conv_id, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS entropy FROM z GROUP BY conv_id)
SELECT conv_id, CAST(i AS INTEGER) AS i, CAST(cluster AS INTEGER) AS cluster, entropy FROM w JOIN e USING (conv_id)""")
def semantic_clusters(spark, root):
    pairs = overlap_pairs(spark, root).withColumn("same", F.col("sim") >= 0.1)
    clusters = gen.semantic_clusters(pairs, "conv_id", "same")
    entropy = gen.cluster_entropy(clusters, "conv_id").select("conv_id", F.round("entropy", 6).alias("entropy"))
    return clusters.join(entropy, "conv_id")
