"""Queries on whole detectors. Fits have no SQL twin: tests/test_detectors.py holds them against plain code.

Stand-ins as in ``model_queries``: rows are embeddings, cut as four layers of 16.
"""

from pyspark.sql import functions as F

from verisieve.functions import arrays as A
from verisieve.operators import detectors, ranks
from verisieve.plans.attention_queries import blocks
from verisieve.plans.feature_queries import detector_features
from verisieve.plans.model_queries import cut, examples
from verisieve.plans.registry import query

MEASURES = ("m0", "m1", "m2", "m3", "m4")


def measured(spark, root):
    return examples(spark, root).withColumns({m: F.col("e")[i] for i, m in enumerate(MEASURES)})


@query("measure_combos")
def measure_combos(spark, root):
    """The measure that is best on the training rows, alone and with other blocks."""
    train, test = detectors.with_best_measure(*cut(measured(spark, root)), ["pair"], list(MEASURES))
    parts = {"measure": F.array("measured"), "score": F.array(A.log_mean(F.transform("e", F.abs))), "hidden": F.slice("e", 33, 32), "laplacian": F.slice("e", 17, 16)}
    combos = {"measure": ("measure",), "score+measure": ("score", "measure"), "measure+hidden": ("measure", "hidden"), "measure+laplacian": ("measure", "laplacian"), "measure+laplacian+hidden": ("measure", "laplacian", "hidden")}
    return detectors.score_combinations(train, test, ["pair"], parts, combos).select("pair", "combo", F.round("auroc", 6).alias("auroc"))


@query("best_measure", """WITH r AS (SELECT vec_id, vec_id % 2 AS pair, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL), l AS (SELECT pair, y, unnest(['m0', 'm1', 'm2', 'm3', 'm4']) AS measure, unnest(range(5)) AS ord, unnest(e[1:5]) AS score FROM r),
k AS (SELECT *, rank() OVER (PARTITION BY pair, measure ORDER BY score) + (count(*) OVER (PARTITION BY pair, measure, score) - 1) / 2.0 AS rk FROM l),
a AS (SELECT pair, measure, ord, (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auroc FROM k GROUP BY ALL)
SELECT CAST(pair AS INTEGER) AS pair, measure FROM a QUALIFY row_number() OVER (PARTITION BY pair ORDER BY auroc DESC, ord) = 1""")
def best_measure(spark, root):
    return detectors.best_measure(measured(spark, root), ["pair"], list(MEASURES))


@query("sink_ablation")
def sink_ablation(spark, root):
    """Sink scores with and without value norms, with and without states."""
    d, v = F.slice("e", 1, 16), F.transform(F.slice("e", 17, 16), F.abs)
    parts = {"sink": A.top_values(d, 10), "sinkv": F.zip_with(A.top_values(d, 10), A.top_gather(d, v, 10), lambda a, b: a * b), "hidden": F.slice("e", 33, 32)}
    combos = {"sink": ("sink",), "sinkv": ("sinkv",), "sink+hidden": ("sink", "hidden"), "sinkv+hidden": ("sinkv", "hidden")}
    return detectors.score_combinations(*cut(examples(spark, root)), ["pair"], parts, combos).select("pair", "combo", F.round("auroc", 6).alias("auroc"))


@query("hidden_probe")
def hidden_probe(spark, root):
    """Three bucket sets and two strengths."""
    rows = examples(spark, root)
    states = rows.select("pair", "vec_id", A.log_mean(F.transform("e", F.abs)).alias("log_prob"), F.posexplode(blocks("e", 4, 16)).alias("layer", "vector"))
    train, test = (d.select("pair", "vec_id", "y") for d in cut(rows))
    buckets = {"wide": {"mid": [0, 1], "late": [2, 3]}, "fixed": {"mid": [1], "late": [3]}, "computed": {"mid": [0], "late": [2]}}
    got = detectors.hidden_probe(train, test, states, buckets, ["pair"], ["vec_id"], {"default": 1.0, "strong": 0.1})
    return ranks.auroc(got, ["pair", "bucket", "strength"], "p").select("pair", "bucket", "strength", "n", F.round("auroc", 6).alias("auroc"))


@query("answer_classifier")
def answer_classifier(spark, root):
    """Group 0 has training rows; group 1 is scored out of five folds."""
    rows = detector_features(spark, root).withColumn("g", (F.col("id") % 2).cast("int")).withColumn("y", (F.pmod(F.xxhash64("id"), F.lit(10)) + 40 * F.col("f3") > 4).cast("int"))
    train = rows.where("g = 0 AND id % 4 = 0")
    test = rows.where("g = 1 OR id % 4 > 0")
    return detectors.answer_classifier(test, ["g"], "id", train).select("id", "g", "y", F.round("p", 6).alias("p"))
