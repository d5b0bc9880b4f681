"""Quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (label 1 over label 0). A linear score is
fitted by logistic loss on the feature differences of the pairs, then cut at the
score quantile that the share of label 0 among the training rows names. Scores are
moved and scaled so that this cut is 0.3.

The fit takes at most ``sample`` labelled rows (those with the smallest hashes of
doc_id; of an id that several rows have the one with the least features) and ``pairs``
pairs; every document is scored over its whole text. Null
text is empty text and gets a score like any other. Labels other than 0 and 1 are
not used; of several labels of a document the smaller counts. With no labels of
one of the two classes every score is 0.5. Repeated documents get equal scores;
extra columns pass through ``filter_documents`` untouched, and an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.common import table, tune
from verisieve.llm.features import NAMES, describe
from verisieve.llm.textvec import pieces

CUT = 0.3


def crc_rest(column: str, modulus: int = 5):
    """crc32 of the id's decimal text modulo ``modulus``; of a null id, null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


@dataclass
class PairwiseModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float
    slope: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; the quantile cut is at 0.3."""
        z = self.slope * (self.raw(features) - self.shift) + np.log(CUT / (1 - CUT)) * (self.slope > 0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def score_text(self, column: pa.Array) -> np.ndarray:
        found = [self.scores(describe(buf, off)) for _, _, buf, off in pieces(column)]
        return np.concatenate(found) if found else np.zeros(0)


def fit_pairwise(features: np.ndarray, label: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 11) -> PairwiseModel:
    """Newton steps on the mean logistic loss of feature differences."""
    width = features.shape[1] if features.ndim == 2 else len(NAMES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return PairwiseModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0)
    mean, scale = features.mean(0), features.std(0) + 1e-9
    z = np.clip((features - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(width)
        w -= np.linalg.solve(curve, gradient)
    s = np.sort(z @ w)
    shift = (s[len(bad) - 1] + s[len(bad)]) / 2
    spread = (z[good] @ w).mean() - (z[bad] @ w).mean()
    return PairwiseModel(mean, scale, w, float(shift), float(8 / max(spread, 1e-6)))


def training_rows(labels: DataFrame, label: str, holdout: bool, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids, the smallest hashes first: doc_id, label."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if holdout:
        rows = rows.where(crc_rest("doc_id") != 0)
    return rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, holdout: bool = True) -> PairwiseModel:
    """Fit on documents whose crc32(doc_id) mod 5 is not 0 (all, without ``holdout``)."""
    tune(docs.sparkSession)
    chosen = F.broadcast(training_rows(labels, label, holdout, sample))  # at most `sample` rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [describe(buf, off) for _, _, buf, off in pieces(batch.column(1))]
            if x:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.vstack(x)), pa.list_(pa.float64())), batch.column(2)], ["label", "x", "doc_id"])

    each = rows.mapInArrow(run, "label int, x array<double>, doc_id long")
    # one row for each id, so at most `sample`
    got = each.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("r.label", "r.x").toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), len(NAMES))
    order = np.lexsort([*x.T, got["label"].to_numpy()])  # the pairs drawn do not depend on the order of arrival
    return fit_pairwise(x[order], got["label"].to_numpy()[order])


def score_documents(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """doc_id, score."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score_text(batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def filter_documents(docs: DataFrame, model: PairwiseModel, cut: float = CUT) -> DataFrame:
    """The documents with a score of ``cut`` or more, with all their columns."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score_text(batch.column(at)) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(crc_rest("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
