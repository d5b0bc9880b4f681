"""Detectors made of the parts: probes of hidden states, answer features, chosen measures, combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisieve.operators import frames, models, ranks, vectors
from verisieve.operators import relational as rel
from verisieve.sources.tables import written

#: The features that the answer classifier uses, of ``features.detector_features``.
ANSWER_FEATURES = ("f1", "f2", "f3", "f4", "f6", "f8", "g1", "g2", "g4", "g8")


def combinations(df: DataFrame, blocks: dict[str, Column], combos: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for each row and combination: combo and x, its blocks one after another. Rows that lack a
    block have no row for combinations that need it."""
    made = df.withColumns({f"_b_{name}": x for name, x in blocks.items()})
    joined = [F.struct(F.lit(name).alias("combo"), F.concat(*[F.col(f"_b_{p}").cast("array<double>") for p in parts]).alias("x")) for name, parts in combos.items()]
    return made.select(*df.columns, F.inline(F.array(*joined))).where("x IS NOT NULL")


def score_combinations(train: DataFrame, test: DataFrame, by: list[str], blocks: dict[str, Column], combos: dict[str, tuple[str, ...]], y: str = "y", **fit) -> DataFrame:
    """``models.fit_score`` of every combination, all fitted in the same passes: by, combo, n_train, n, n_pos, auroc."""
    a, b = (combinations(df, blocks, combos) for df in (train, test))
    return models.fit_score(a, b, [*by, "combo"], "x", y, **fit)


def best_measure(train: DataFrame, by: list[str], measures: list[str], y: str = "y") -> DataFrame:
    """by, measure: the measure of the best AUROC on the training rows, the earlier of equals."""
    long = train.select(*by, y, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(i).alias("ord"), F.col(m).cast("double").alias("score")) for i, m in enumerate(measures)])))
    return rel.argmax(ranks.auroc(long, [*by, "measure", "ord"], "score", y), by, "auroc", "ord", ["measure"])


def with_best_measure(train: DataFrame, test: DataFrame, by: list[str], measures: list[str], y: str = "y", out: str = "measured") -> tuple[DataFrame, DataFrame]:
    """Both tables with the value of the measure that is best on the training rows; a row that lacks it has null."""
    best = best_measure(train, by, measures, y)
    value = F.coalesce(*[F.when(F.col("measure") == m, F.col(m).cast("double")) for m in measures])
    put = lambda df: df.join(best, by).withColumn(out, F.when(~F.isnan(value), value))
    return put(train), put(test)


def hidden_probe(train: DataFrame, test: DataFrame, states: DataFrame, buckets: dict[str, dict[str, list[int]]], by: list[str], key: list[str], strengths: dict[str, float], y: str = "y") -> DataFrame:
    """by, key, y, bucket, strength, p: probes fitted on ``train`` (paired examples) that score ``test``.

    ``states`` has by, key, layer, vector and log_prob. Each layer is standardised by the mean and
    deviation over the training rows; a bucket set names the layers that are averaged."""
    mine = frames.restricted(states, train.select(*by, *key), [*by, *key])
    stats = vectors.mean_and_deviation(mine, [*by, "layer"], "vector", 1e-6)
    x = reduce(DataFrame.unionByName, [frames.bucket_vector(states, stats, layers, [*by, *key], "log_prob").withColumn("bucket", F.lit(name)) for name, layers in buckets.items()])
    a, b = train.join(x, [*by, *key]), test.join(x, [*by, *key])
    model = models.fit_logistic(a, [*by, "bucket"], "x", y, strengths=strengths)
    each = b.withColumn("strength", F.explode(F.array(*map(F.lit, strengths))))
    return models.predict(each, model, [*by, "bucket", "strength"], "x").select(*by, *key, y, "bucket", "strength", "p")


def answer_classifier(test: DataFrame, by: list[str], key: str, train: DataFrame | None = None, y: str = "y", features: tuple[str, ...] = ANSWER_FEATURES, folds: int = 5) -> DataFrame:
    """by, key, y, p: fitted on the training rows where there are any for the group, else by
    scores out of ``folds`` folds of the test rows. A group of one class has no scores."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = written(test.select(*by, key, y, vector.alias("x")))
    if train is None:
        return models.out_of_fold(rows, by, key, "x", y, folds).select(*by, key, y, "p")
    given = written(train.select(*by, key, y, vector.alias("x")))
    have = F.broadcast(given.select(*by).distinct())  # groups, so that the rows of one do not meet in a task
    told = models.predict(rows.join(have, by, "left_semi"), models.fit_logistic(given, by, "x", y), by, "x").select(*by, key, y, "p")
    return told.unionByName(models.out_of_fold(rows.join(have, by, "left_anti"), by, key, "x", y, folds).select(*by, key, y, "p"))
