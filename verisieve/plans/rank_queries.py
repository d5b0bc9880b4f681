"""Queries on ranked statistics over labelled documents.

Stand-ins: y is toxic, a pair is a language, the band is HI above the language's median
length, methods are three text statistics.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verisieve.operators import ranks
from verisieve.operators import relational as rel
from verisieve.plans.registry import query
from verisieve.sources.tables import table

METHODS = ("length", "spaces", "residue")
EX = """
ex AS (
  SELECT d.doc_id AS id, d.lang AS pair, l.toxic AS y, l.quality AS quality, d.n_chars > quantile_cont(d.n_chars, 0.5) OVER (PARTITION BY d.lang) AS hi,
    CAST(d.n_chars AS DOUBLE) AS length, CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS spaces, CAST(d.doc_id % 97 AS DOUBLE) AS residue
  FROM documents d JOIN labels l USING (doc_id)
), example AS (
  SELECT *, CASE WHEN y = 1 AND hi THEN 'IH' WHEN y = 1 THEN 'IL' WHEN hi THEN 'CH' ELSE 'CL' END AS category FROM ex
), long AS (
  SELECT id, pair, y, quality, hi, category, 'length' AS method, 0 AS ord, length AS score FROM example
  UNION ALL SELECT id, pair, y, quality, hi, category, 'spaces', 1, spaces FROM example
  UNION ALL SELECT id, pair, y, quality, hi, category, 'residue', 2, residue FROM example
)"""
PAIRWISE = (("IHvCH", "IH", 1, 0), ("IHvCH", "CH", 0, 0), ("IHvCL", "IH", 1, 0), ("IHvCL", "CL", 0, 0), ("ILvCH", "IL", 1, 0), ("ILvCH", "CH", 0, 0), ("ILvCL", "IL", 1, 0), ("ILvCL", "CL", 0, 0))
POOLED = tuple((f"{t}v{'C' if t[0] == 'I' else 'I'}", c, role, int(t[0] == "C")) for t in ("IH", "IL", "CH", "CL") for c, role in ([(t, 1 if t[0] == "I" else 1)] + [(("C" if t[0] == "I" else "I") + b, 0) for b in "HL"]))
OVR = tuple((f"{t}vR", c, int(c == t), int(t[0] == "C")) for t in ("IH", "IL", "CH", "CL") for c in ("IH", "IL", "CH", "CL"))


def dim_sql(rows):
    return "dim(contrast, category, role, flip) AS (VALUES " + ", ".join(map(str, rows)) + ")"


def auroc_sql(source, keys, y="y"):
    """One row of n, n_pos and auroc for each group of ``source``."""
    k = ", ".join(keys)
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS rk FROM {source}),
a AS (SELECT {k}, count(*) AS n, CAST(sum({y}) AS BIGINT) AS n_pos, CASE WHEN sum({y}) > 0 AND sum({y}) < count(*)
  THEN (sum(CASE WHEN {y} = 1 THEN rk END) - sum({y}) * (sum({y}) + 1) / 2.0) / (sum({y}) * (count(*) - sum({y}))) END AS auroc FROM r GROUP BY {k})"""


def examples(spark, root):
    d, l = table(spark, root, "documents"), table(spark, root, "labels")
    ex = d.join(l, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("pair"), F.col("toxic").alias("y"), "quality", "n_chars",
        F.col("n_chars").cast("double").alias("length"), (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))).cast("double").alias("spaces"), (F.col("doc_id") % 97).cast("double").alias("residue"),
    )
    middle = ex.groupBy("pair").agg(F.percentile("n_chars", F.lit(0.5)).alias("_m"))
    ex = ex.join(F.broadcast(middle), "pair").withColumn("hi", F.col("n_chars") > F.col("_m")).drop("n_chars", "_m")
    return ex.withColumn("category", F.concat(F.when(F.col("y") == 1, "I").otherwise("C"), F.when(F.col("hi"), "H").otherwise("L")))


def long_scores(spark, root):
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("ord"), F.col(m).alias("score")) for i, m in enumerate(METHODS)])
    return examples(spark, root).select("id", "pair", "y", "quality", "hi", "category", F.inline(methods))


def dim(spark, rows):
    return spark.createDataFrame(rows, "contrast string, category string, role int, flip int")


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("auroc_by_lang", f"WITH {EX}, s AS (SELECT pair AS lang, y, length AS score FROM example), {auroc_sql('s', ['lang'])} SELECT lang, n, n_pos, round(auroc, 6) AS auroc FROM a")
def auroc_by_lang(spark, root):
    rows = table(spark, root, "documents").join(table(spark, root, "labels"), "doc_id").select("lang", F.col("toxic").alias("y"), F.col("n_chars").cast("double").alias("score"))
    return rounded(ranks.auroc(rows, ["lang"]), "auroc")


def _contrast(name, rows):
    sql = f"WITH {EX}, {dim_sql(rows)}, s AS (SELECT l.pair, l.method, d.contrast, d.flip, d.role AS y, l.score FROM long l JOIN dim d USING (category)), {auroc_sql('s', ['pair', 'method', 'contrast', 'flip'])} SELECT pair, method, contrast, n, n_pos, round(CASE WHEN flip = 1 THEN 1 - auroc ELSE auroc END, 6) AS auroc FROM a"

    @query(name, sql)
    def run(spark, root):
        return rounded(ranks.contrasts(long_scores(spark, root), dim(spark, rows), ["pair", "method"]), "auroc")


_contrast("auroc_band_pairwise", PAIRWISE)
_contrast("auroc_band_pooled", POOLED)
_contrast("auroc_one_vs_rest", OVR)


@query("auroc_balanced_means", f"""WITH {EX}, {dim_sql(POOLED)}, s AS (SELECT l.pair, l.method, d.contrast, d.flip, d.role AS y, l.score FROM long l JOIN dim d USING (category)), {auroc_sql('s', ['pair', 'method', 'contrast', 'flip'])},
f AS (SELECT pair, method, contrast, CASE WHEN flip = 1 THEN 1 - auroc ELSE auroc END AS v FROM a)
SELECT pair, method, round(avg(v) FILTER (contrast IN ('IHvC', 'ILvC')), 6) AS incorrect_mean, round(avg(v) FILTER (contrast IN ('CHvI', 'CLvI')), 6) AS correct_mean FROM f GROUP BY pair, method""")
def auroc_balanced_means(spark, root):
    a = ranks.contrasts(long_scores(spark, root), dim(spark, POOLED), ["pair", "method"])
    pick = lambda *c: F.avg(F.when(F.col("contrast").isin(*c), F.col("auroc")))
    return rounded(a.groupBy("pair", "method").agg(pick("IHvC", "ILvC").alias("incorrect_mean"), pick("CHvI", "CLvI").alias("correct_mean")), "incorrect_mean", "correct_mean")


@query("raw_score_bands_guarded", f"WITH {EX}, {auroc_sql('long', ['pair', 'method', 'hi'])} SELECT pair, method, hi, n, n_pos, round(CASE WHEN least(n_pos, n - n_pos) >= 5 THEN auroc END, 6) AS auroc FROM a")
def raw_score_bands_guarded(spark, root):
    return rounded(ranks.guarded(ranks.auroc(long_scores(spark, root), ["pair", "method", "hi"]), 5), "auroc")


@query("category_means_counts", f"""WITH {EX} SELECT pair, method, count(*) AS n, count(*) FILTER (category = 'IH') AS n_ih, count(*) FILTER (category = 'CH') AS n_ch, count(*) FILTER (category = 'IL') AS n_il, count(*) FILTER (category = 'CL') AS n_cl,
round(avg(score) FILTER (category = 'IH'), 6) AS mean_ih, round(avg(score) FILTER (category = 'CH'), 6) AS mean_ch, round(avg(score) FILTER (category = 'IL'), 6) AS mean_il, round(avg(score) FILTER (category = 'CL'), 6) AS mean_cl FROM long GROUP BY pair, method""")
def category_means_counts(spark, root):
    cats = ("IH", "CH", "IL", "CL")
    return long_scores(spark, root).groupBy("pair", "method").agg(F.count("*").alias("n"), *[F.count_if(F.col("category") == c).alias(f"n_{c.lower()}") for c in cats], *[F.round(F.avg(F.when(F.col("category") == c, F.col("score"))), 6).alias(f"mean_{c.lower()}") for c in cats])


@query("best_method_per_pair", f"WITH {EX}, {auroc_sql('long', ['pair', 'method', 'ord'])} SELECT pair, method, round(auroc, 6) AS auroc FROM a QUALIFY row_number() OVER (PARTITION BY pair ORDER BY coalesce(auroc, -1) DESC, ord) = 1")
def best_method_per_pair(spark, root):
    return rounded(rel.argmax(ranks.auroc(long_scores(spark, root), ["pair", "method", "ord"]), ["pair"], "auroc", "ord", ["method", "auroc"]), "auroc")


@query("method_mean_with_total", f"WITH {EX}, {auroc_sql('long', ['pair', 'method'])} SELECT coalesce(pair, 'MEAN') AS pair, method, round(avg(auroc), 6) AS auroc FROM a GROUP BY GROUPING SETS ((pair, method), (method))")
def method_mean_with_total(spark, root):
    a = ranks.auroc(long_scores(spark, root), ["pair", "method"]).select("pair", "method", "auroc")
    return rounded(a.unionByName(a.groupBy("method").agg(F.avg("auroc").alias("auroc")).withColumn("pair", F.lit("MEAN"))), "auroc")


@query("score_pivot_wide", f"WITH {EX}, {auroc_sql('long', ['pair', 'method'])} SELECT pair, round(max(auroc) FILTER (method = 'length'), 6) AS length, round(max(auroc) FILTER (method = 'spaces'), 6) AS spaces, round(max(auroc) FILTER (method = 'residue'), 6) AS residue FROM a GROUP BY pair")
def score_pivot_wide(spark, root):
    return rounded(ranks.auroc(long_scores(spark, root), ["pair", "method"]).groupBy("pair").pivot("method", list(METHODS)).agg(F.max("auroc")), *METHODS)


@query("confusion_metrics", f"""WITH {EX}, p AS (SELECT pair, quality AS y, CASE WHEN spaces / greatest(length, 1) >= 0.15 THEN 1 ELSE 0 END AS hat FROM example)
SELECT pair, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_wrong, round(avg(CASE WHEN hat = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(coalesce(sum(hat * y) / nullif(sum(hat), 0), 0), 6) AS precision,
round(coalesce(sum(hat * y) / nullif(sum(y), 0), 0), 6) AS recall, round(coalesce(2 * sum(hat * y) / nullif(sum(hat) + sum(y), 0), 0), 6) AS f1 FROM p GROUP BY pair""")
def confusion_metrics(spark, root):
    rows = examples(spark, root).select("pair", F.col("quality").alias("y"), (F.col("spaces") / F.greatest("length", F.lit(1.0))).alias("p"))
    return rounded(ranks.confusion(rows, ["pair"], cut=0.15), "accuracy", "precision", "recall", "f1")


@query("auarc_curve", f"WITH {EX}, c AS (SELECT pair, method, avg(1.0 - y) OVER (PARTITION BY pair, method ORDER BY score, id ROWS UNBOUNDED PRECEDING) AS acc FROM long) SELECT pair, method, round(avg(acc), 6) AS auarc FROM c GROUP BY pair, method")
def auarc_curve(spark, root):
    rows = long_scores(spark, root).withColumn("ok", 1 - F.col("y"))
    return rounded(ranks.auarc(rows, ["pair", "method"], "score", "ok", "id"), "auarc")


@query("average_precision", f"""WITH {EX}, g AS (SELECT pair, method, score, sum(y) AS p, count(*) AS n FROM long GROUP BY ALL), c AS (SELECT *, p * sum(p) OVER w / sum(n) OVER w AS t FROM g WINDOW w AS (PARTITION BY pair, method ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT pair, method, round(sum(t) / nullif(sum(p), 0), 6) AS average_precision FROM c GROUP BY pair, method""")
def average_precision(spark, root):
    return rounded(ranks.average_precision(long_scores(spark, root), ["pair", "method"], "score", "y"), "average_precision")


@query("mann_whitney_cells", f"""WITH {EX}, r AS (SELECT *, rank() OVER (PARTITION BY pair, method ORDER BY score) + (count(*) OVER (PARTITION BY pair, method, score) - 1) / 2.0 AS rk FROM long),
t AS (SELECT pair, method, sum(c * c * c - c) AS ties FROM (SELECT pair, method, score, CAST(count(*) AS DOUBLE) AS c FROM long GROUP BY ALL) GROUP BY ALL),
u AS (SELECT pair, method, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0 AS u FROM r GROUP BY pair, method),
v AS (SELECT *, n_pos * (n - n_pos) / 12.0 * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1))) AS var FROM u JOIN t USING (pair, method))
SELECT pair, method, n, n_pos, u, round(CASE WHEN var > 0 THEN greatest(abs(u - n_pos * (n - n_pos) / 2.0) - 0.5, 0) / sqrt(var) END, 6) AS z FROM v""")
def mann_whitney_cells(spark, root):
    return rounded(ranks.mann_whitney(long_scores(spark, root), ["pair", "method"]), "z")


@query("bh_fdr", f"""WITH {EX}, p AS (SELECT id, pair, (residue + 1) / 98.0 AS p FROM example), k AS (SELECT *, p * count(*) OVER (PARTITION BY pair) / row_number() OVER (PARTITION BY pair ORDER BY p, id) AS q0 FROM p)
SELECT id, pair, round(least(1, min(q0) OVER (PARTITION BY pair ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k""")
def bh_fdr(spark, root):
    p = examples(spark, root).select("id", "pair", ((F.col("residue") + 1) / 98.0).alias("p"))
    return rounded(ranks.benjamini_hochberg(p, ["pair"], "p", "id").drop("p"), "q")


@query("specialist_delta", f"""WITH {EX}, s AS (SELECT pair, method, hi, y, score FROM long), {auroc_sql('s', ['pair', 'method', 'hi'])}, g AS (SELECT pair, method, avg(auroc) AS general FROM a GROUP BY ALL)
SELECT pair, method, hi, round(auroc - general, 6) AS delta FROM a LEFT JOIN g USING (pair, method)""")
def specialist_delta(spark, root):
    a = ranks.auroc(long_scores(spark, root), ["pair", "method", "hi"])
    g = a.groupBy("pair", "method").agg(F.avg("auroc").alias("general"))
    return a.join(g, ["pair", "method"], "left").select("pair", "method", "hi", F.round(F.col("auroc") - F.col("general"), 6).alias("delta"))


@query("stratified_split", f"WITH {EX}, r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || id), id) AS rk, count(*) OVER (PARTITION BY y) AS n FROM example) SELECT id, y, rk <= round_even(0.3 * n, 0) AS is_test FROM r")
def stratified_split(spark, root):
    return rel.stratified_split(examples(spark, root).select("id", "y"), ["y"], "id", 0.3, "42")


@query("stratified_folds", f"WITH {EX} SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || id), id) - 1) % 5 AS INTEGER) AS fold FROM example")
def stratified_folds(spark, root):
    return rel.stratified_folds(examples(spark, root).select("id", "y"), ["y"], "id", 5, "42")


@query("balanced_sample", f"WITH {EX} SELECT id, category FROM example QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('7|' || id), id) <= 40 // 4")
def balanced_sample(spark, root):
    return rel.balanced_sample(examples(spark, root).select("id", "category"), "category", "id", 40, 4, "7")
