"""Uncertainty of sampled answers to one question.

Answers of a question are pairs' worth of work, so ``first_answers`` keeps the first ten, as
the measures are defined; every later step is bounded by that number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisieve.operators import ranks
from verisieve.sources.tables import written

ANSWERS = 10


def answers_of_map(line: Column, most: int = ANSWERS) -> Column:
    """Cleaned answers by example of a JSON line ``{id: {"responses": [...]}}``; examples with fewer than two are left out."""
    entries = F.map_entries(F.from_json(line, "map<string,struct<responses:array<string>>>"))
    clean = F.transform(entries, lambda e: F.struct(e["key"].alias("id"), F.filter(F.transform(F.slice(e["value"]["responses"], 1, most), lambda a: F.regexp_replace(a, r"^\s+|\s+$", "")), lambda a: a != "").alias("answers")))
    return F.filter(clean, lambda e: F.size(e["answers"]) >= 2)


def first_answers(df: DataFrame, key: str, order: str, most: int = ANSWERS) -> DataFrame:
    """The first ``most`` answers of each question, column i from 0."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).withColumn("i", F.col("_rank") - 1).drop("_rank")


def answer_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Ordered pairs (key, i, j, a, b) of a question's answers, itself included."""
    many = F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v"))))
    one = df.groupBy(key).agg(many.alias("_l"))
    return one.select(key, F.explode("_l").alias("_a"), "_l").select(key, "_a", F.explode("_l").alias("_b")).select(key, F.col("_a.i").alias("i"), F.col("_b.i").alias("j"), F.col("_a.v").alias("a"), F.col("_b.v").alias("b"))


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; rows as bits of one integer."""
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of word arrays; 0 where either is empty."""
    out = []
    for x, y in zip(a, b):
        x, y = ([] if v is None else list(v) for v in (x, y))
        n = longest_common(x, y) if x and y else 0
        out.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
    return pd.Series(out, dtype=float)


def rouge_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def lexical_similarity(df: DataFrame, key: str, text: str) -> DataFrame:
    """Negative mean ROUGE-L over pairs i < j of a question's answers."""
    words = df.select(key, "i", rouge_words(F.col(text)).alias("w"))
    pairs = answer_pairs(words, key, "w").where("i < j")
    return pairs.withColumn("_r", rouge_l("a", "b")).groupBy(key).agg((-F.avg("_r")).alias("lexical_similarity"))


def matrix(pairs: DataFrame, key: str, sim: str) -> DataFrame:
    """One row a question: n and the row-major similarities."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", F.col(sim).cast("double").alias("s"))))
    return pairs.groupBy(key).agg(F.transform(cells, lambda c: c["s"]).alias("_w"), F.countDistinct("i").alias("n"))


def spectrum(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the normalised Laplacian of the symmetrised similarities."""
    n = int(round(len(flat) ** 0.5))
    w = np.asarray(flat, float).reshape(n, n)
    w = (w + w.T) / 2
    root = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    return np.linalg.eigh(np.eye(n) - root[:, None] * w * root)


@F.pandas_udf(T.StructType().add("sum_eigv", "double").add("eccentricity", "double"))
def spectral(w: pd.Series) -> pd.DataFrame:
    out = []
    for flat in w:
        values, vectors = spectrum(flat)
        near = vectors[:, values < 0.9]
        out.append((np.maximum(0, 1 - values).sum(), float(np.linalg.norm(near - near.mean(0)))))
    return pd.DataFrame(out, columns=["sum_eigv", "eccentricity"])


def spectral_measures(pairs: DataFrame, key: str, sim: str) -> DataFrame:
    """sum_eigv: sum of max(0, 1 - eigenvalue); eccentricity: norm of the centred small-eigenvalue embedding."""
    return matrix(pairs, key, sim).select(key, spectral("_w").alias("_s")).select(key, "_s.*")


def weighted_measures(pairs: DataFrame, key: str, sim: str, tau: float = 1.0) -> DataFrame:
    """luq, degree and snne from similarities, all in the JVM."""
    rows = pairs.groupBy(key, "i").agg(F.avg(F.when(F.col("i") != F.col("j"), F.col(sim))).alias("o"), F.log(F.sum(F.exp(F.col(sim) / tau))).alias("l"), F.sum(sim).alias("t"))
    n = F.count("*")
    return rows.groupBy(key).agg((1 - F.avg("o")).alias("luq"), (1 - F.sum("t") / (n * n)).alias("degree"), (-F.avg("l")).alias("snne"))


def semantic_clusters(pairs: DataFrame, key: str, same: str) -> DataFrame:
    """Each answer's cluster, in order: it joins the first earlier cluster whose first answer is equivalent both ways.

    (key, i, cluster); ``same`` says that a entails b. An answer starts a cluster unless it
    matches an earlier starter, so the state is the array of starters.
    """
    cells = F.array_sort(F.collect_list(F.struct("i", "j", F.col(same).cast("boolean").alias("s"))))
    one = pairs.groupBy(key).agg(cells.alias("_c"))
    both = one.select(key, "_c", F.array_sort(F.array_distinct(F.transform("_c", lambda c: c["i"]))).alias("_i"))
    said = lambda a, b: F.exists("_c", lambda c: (c["i"] == a) & (c["j"] == b) & c["s"])
    start = F.array().cast("array<struct<i:int,cluster:int>>")

    def put(done: Column, i: Column) -> Column:
        hit = F.filter(done, lambda d: (d["i"] == d["cluster"]) & said(d["i"], i) & said(i, d["i"]))
        where = F.coalesce(F.try_element_at(hit, F.lit(1))["i"], i)
        return F.concat(done, F.array(F.struct(i.cast("int").alias("i"), where.cast("int").alias("cluster"))))

    return both.select(key, F.inline(F.aggregate("_i", start, put)))


#: Places of the entailment classes in a model's probabilities: fixed values.
CONTRADICTION, NEUTRAL, ENTAILMENT = 0, 1, 2


def entailment_score(p: Column, variant: str = "strict") -> Column:
    """A similarity from class probabilities: ``strict`` is p(entailment); ``luq`` its share of
    entailment and contradiction; ``weighted`` counts neutral half."""
    if variant == "strict":
        return p[ENTAILMENT]
    if variant == "luq":
        return p[ENTAILMENT] / (p[ENTAILMENT] + p[CONTRADICTION])
    if variant == "weighted":
        return p[ENTAILMENT] + p[NEUTRAL] * 0.5
    raise ValueError(f"no variant {variant}")


def probabilities(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda s, w: s + w))


def entailment_pairs(answers: DataFrame, key: str, question: str, answer: str, model: callable, memo: str | None = None) -> DataFrame:
    """key, i, j, p: class probabilities of every ordered pair of a question's answers, each read
    after its question. ``model`` maps two series of texts to logits, once for each distinct pair;
    ``memo`` is as for ``memo_pairs``."""
    said = answers.select(key, "i", F.concat_ws(" ", question, answer).alias("_s"))
    pairs = answer_pairs(said, key, "_s")
    return memo_pairs(pairs, model, "array<double>", memo).select(key, "i", "j", probabilities(F.col("sim")).alias("p"))


def equivalent_answers(pairs: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """key, i, j, same: by the likeliest classes of (i, j) and (j, i). ``strict``: both entail;
    else neither contradicts and not both are neutral. Of equal classes the first is likeliest."""
    said = F.array_position("p", F.array_max("p")) - 1
    one = pairs.select(key, "i", "j", said.alias("_a"))
    back = one.select(key, F.col("i").alias("j"), F.col("j").alias("i"), F.col("_a").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    same = (a == ENTAILMENT) & (b == ENTAILMENT) if strict else (a != CONTRADICTION) & (b != CONTRADICTION) & ~((a == NEUTRAL) & (b == NEUTRAL))
    return one.join(back, [key, "i", "j"]).select(key, "i", "j", same.alias("same"))


def prefixes(pairs: DataFrame, own: DataFrame, defaults: DataFrame) -> DataFrame:
    """``pairs`` (pair, dataset) with the few-shot prefix of the pair's own run, else of its dataset; none is an error."""
    rows = pairs.join(own.select("pair", F.col("prefix").alias("_o")), "pair", "left").join(defaults.select("dataset", F.col("prefix").alias("_d")), "dataset", "left")
    lacking = F.raise_error(F.concat(F.lit("no prefix for "), "pair")).cast("string")
    return rows.withColumn("prefix", F.coalesce("_o", "_d", lacking)).drop("_o", "_d")


def cluster_entropy(clusters: DataFrame, key: str) -> DataFrame:
    """Entropy of the cluster sizes (natural logarithm)."""
    sizes = clusters.groupBy(key, "cluster").agg(F.count("*").alias("c"))
    total = F.sum("c")
    return sizes.groupBy(key).agg((F.log(total) - F.sum(F.col("c") * F.log("c")) / total).alias("entropy"))


def memo_pairs(pairs: DataFrame, model: callable, schema: str = "double", memo: str | None = None) -> DataFrame:
    """Column sim: ``model(a, b)`` once for each distinct pair of texts.

    ``memo`` is the path of a table of what this model has said, by the SHA-256 of the two texts: pairs
    that it holds are joined, the others go to the model batch by batch and are appended. So a pair
    is read once in all runs, and a run that is killed loses a batch."""
    from verisieve.sources import sinks

    call = F.pandas_udf(model, schema)
    name = F.sha2(F.concat(F.length("a").cast("string"), F.lit(":"), "a", "b"), 256)
    named = pairs.withColumn("_pair", F.coalesce(name, F.to_json(F.struct("a", "b"))))
    seen = named.select("_pair", "a", "b").distinct()
    said = lambda df: df.select("_pair", call("a", "b").alias("sim"))
    known = said(seen) if memo is None else sinks.resume(seen, memo, ["_pair"], said)
    return named.join(known, "_pair").select(*pairs.columns, "sim")


#: The measures of a question, as they are named in tables.
MEASURES = ("num_set", "lexical_sim", "sum_eigv", "degree", "eccentricity", "luq", "snne")


def uncertainty_records(answers: DataFrame, key: str, question: str, answer: str, model: callable, memo: str | None = None) -> DataFrame:
    """key and the seven ``MEASURES`` of every question with two answers or more.

    Answers are read after their question. num_set counts the clusters of answers that are equivalent
    both ways (not strictly); lexical_sim is minus the mean ROUGE-L; the graph measures and snne take
    p(entailment), luq the share of entailment without neutral. The model is asked once."""
    said = answers.withColumn("_said", F.concat_ws(" ", question, answer))
    p = written(entailment_pairs(answers, key, question, answer, model, memo))
    strict, loose = (p.select(key, "i", "j", entailment_score(F.col("p"), v).alias("sim")) for v in ("strict", "luq"))
    sets = semantic_clusters(equivalent_answers(p, key), key, "same").groupBy(key).agg(F.countDistinct("cluster").cast("double").alias("num_set"))
    parts = [
        sets,
        lexical_similarity(said, key, "_said").withColumnRenamed("lexical_similarity", "lexical_sim"),
        spectral_measures(strict, key, "sim"),
        weighted_measures(strict, key, "sim").select(key, "degree", "snne"),
        weighted_measures(loose, key, "sim").select(key, "luq"),
    ]
    out = answers.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    for part in parts:
        out = out.join(part, key)
    return out.select(key, *MEASURES)


def measure_table(records: DataFrame, by: list[str], key: str, correct: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """by, method, auroc, auarc, aucpr, n: how well each measure tells wrong answers from right ones.

    auroc is that of a wrong answer; auarc the area under the accuracy-rejection curve, ties by
    ``key``; aucpr the average precision of right answers, surest first."""
    values = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("_u")) for m in measures])
    long = records.select(*by, key, F.col(correct).cast("int").alias("_right"), F.inline(values))
    long = written(long.where(F.col("_right").isNotNull()).withColumns({"_wrong": 1 - F.col("_right"), "_sure": -F.col("_u")}))
    keys = [*by, "method"]
    told = ranks.auroc(long, keys, "_u", "_wrong").select(*keys, "auroc", "n")
    curve = ranks.auarc(long.where(F.col("_u").isNotNull() & ~F.isnan("_u")), keys, "_u", "_right", key)
    precise = ranks.average_precision(long, keys, "_sure", "_right").withColumnRenamed("average_precision", "aucpr")
    return told.join(curve, keys).join(precise, keys).select(*keys, "auroc", "auarc", "aucpr", "n")
