"""Detector features over per-layer scores, and the choice of layers."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisieve.functions import arrays as A
from verisieve.operators import ranks
from verisieve.operators import relational as rel


def last_layer(scores: Column) -> Column:
    """Value at the largest key of a map by layer; null for an empty map."""
    top = F.array_max(F.transform(F.map_keys(scores), lambda k: k.cast("int")))
    entries = F.filter(F.map_entries(scores), lambda e: e["key"].cast("int") == top)
    return F.try_element_at(entries, F.lit(1))["value"].cast("double")


def at_layer(scores: Column, layer: int) -> Column:
    found = F.filter(F.map_entries(scores), lambda e: e["key"].cast("int") == layer)
    return F.try_element_at(found, F.lit(1))["value"].cast("double")


def detector_features(df: DataFrame, best: int, early: int, keep: list[str]) -> DataFrame:
    """Twelve features from columns s_int, s_ext (maps by layer), n_tokens and distractors
    (array of structs of the same three). Rows without an internal score at ``best``, an
    external score, a distractor score or a length are left out."""
    some = lambda a: F.filter(a, lambda v: v.isNotNull())
    d = F.col("distractors")
    rows = df.select(
        *keep, at_layer(F.col("s_int"), best).alias("f1"), last_layer(F.col("s_ext")).alias("f2"), at_layer(F.col("s_int"), early).alias("_early"),
        some(F.transform(d, lambda x: at_layer(x["s_int"], best))).alias("_di"), some(F.transform(d, lambda x: F.exp(last_layer(x["s_ext"])))).alias("_de"),
        F.filter(F.transform(d, lambda x: x["n_tokens"].cast("double")), lambda v: v != 0).alias("_dn"), F.col("n_tokens").cast("double").alias("g1"),
        A.mean(F.filter(F.map_values("s_int"), lambda v: v.isNotNull())).alias("_traj"),
    ).where("f1 IS NOT NULL AND f2 IS NOT NULL AND size(_di) > 0 AND g1 > 0")
    m = A.mean(F.col("_di"))
    f3 = F.col("f1") - m
    return rows.select(
        *keep, "f1", "f2", f3.alias("f3"), (f3 - F.when(F.size("_de") > 0, F.exp("f2") - A.mean(F.col("_de"))).otherwise(0.0)).alias("f4"),
        A.mean(F.transform("_di", lambda v: F.pow(v - m, F.lit(2)))).alias("f5"), (F.array_max("_di") - F.col("f1")).alias("f6"),
        (F.size(F.filter("_di", lambda v: F.col("f1") > v)) / F.size("_di")).alias("f7"), F.coalesce(F.col("f1") - F.col("_early"), F.lit(0.0)).alias("f8"),
        "g1", (F.col("f2") / F.col("g1")).alias("g2"), F.coalesce("_traj", "f1").alias("g4"), F.coalesce(F.col("g1") - A.mean(F.col("_dn")), F.lit(0.0)).alias("g8"),
    )


def layer_auroc(df: DataFrame, by: list[str], mine: str, other: str, least: int = 10) -> DataFrame:
    """AUROC by layer of ``mine`` against winning over ``other``; null below ``least`` rows."""
    rows = df.where(F.col(mine).isNotNull() & F.col(other).isNotNull()).withColumn("_won", (F.col(mine) > F.col(other)).cast("int"))
    out = ranks.auroc(rows, [*by, "layer"], mine, "_won")
    return out.withColumn("auroc", F.when(F.col("n") >= least, F.col("auroc")))


def peak_layers(scores: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """First best layer of each region (``regions``: by, region, layers array); the middle layer where none is scored.

    The regions are a fixed table of a few rows.
    """
    at = scores.select(*by, F.col("layer").alias("_layer"), F.col("auroc").alias("_a")).where("_a IS NOT NULL")
    named = regions.select(*by, "region", "layers", F.explode("layers").alias("_layer"))
    found = named.join(at, [*by, "_layer"]) if by else named.join(at, "_layer")
    best = rel.argmax(found, [*by, "region"], "_a", "_layer", ["_layer", "_a"])
    middle = F.element_at("layers", (F.floor(F.size("layers") / 2) + 1).cast("int"))
    return regions.join(best, [*by, "region"], "left").select(*by, "region", F.coalesce("_layer", middle).alias("peak"), F.col("_a").alias("auroc"))


def widest_layer(df: DataFrame, by: list[str], divergence: str, layers: int) -> DataFrame:
    """Layer of largest mean absolute divergence, the lower of ties; max(layers / 2, 15) where none has a value."""
    means = df.groupBy(*by, "layer").agg(F.avg(F.abs(divergence)).alias("_m"))
    best = rel.argmax(means, by, "_m", "layer", ["layer", "_m"])
    return best.select(*by, F.when(F.col("_m").isNull(), max(layers // 2, 15)).otherwise(F.col("layer")).alias("layer"))


def bucket_layers(pairs: DataFrame, wide: DataFrame, fixed: DataFrame, computed: DataFrame, variant: str) -> DataFrame:
    """Layers of (model, dataset, region): by model if wide, else the pair's fixed entry, else its computed one; none is an error."""
    rows = pairs.join(F.broadcast(wide.withColumnRenamed("layers", "_w")), ["model", "region"], "left")
    for df, name in ((fixed, "_f"), (computed, "_c")):
        rows = rows.join(F.broadcast(df.withColumnRenamed("layers", name)), ["model", "dataset", "region"], "left")
    found = F.col("_w") if variant == "wide" else F.coalesce("_f", "_c")
    where = F.concat_ws(" ", F.lit("no layers for"), "model", "dataset", "region")
    return rows.withColumn("layers", F.coalesce(found, F.raise_error(where).cast("array<int>"))).drop("_w", "_f", "_c")


def shared_heads(queries: DataFrame, values: DataFrame, by: list[str], group: int, a: str, b: str) -> DataFrame:
    """Query head h with key-value head h div group; rows of unequal length are skipped."""
    q = queries.withColumn("kv_head", F.floor(F.col("head") / group).cast("int"))
    v = values.select(*by, F.col("head").cast("int").alias("kv_head"), b)
    return q.join(v, [*by, "kv_head"]).where(F.size(a) == F.size(b))


@lru_cache(maxsize=None)
def rank_counts(m: int, n: int) -> tuple[int, ...]:
    """Number of orders of m and n untied values for each U."""
    row = [1] + [0] * (m * n)
    for k in range(1, min(m, n) + 1):
        top, low = m + n + 1 - k, k
        for u in range(m * n, top - 1, -1):
            row[u] -= row[u - top]
        for u in range(low, m * n + 1):
            row[u] += row[u - low]
    return tuple(row)


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, z: pd.Series, n: pd.Series, n_pos: pd.Series, tied: pd.Series) -> pd.Series:
    """Two-sided p of U: exact where the smaller class has at most 8 rows and nothing ties, else normal; 1 where all are equal."""
    out = []
    for one, zz, total, pos, tie in zip(u, z, n, n_pos, tied):
        m, k = int(pos), int(total - pos)
        if not m or not k:
            out.append(None)
        elif min(m, k) <= 8 and not tie:
            counts = rank_counts(m, k)
            more = max(one, m * k - one)
            out.append(min(1.0, 2 * sum(counts[math.ceil(more) :]) / math.comb(m + k, m)))
        else:
            out.append(1.0 if pd.isna(zz) else min(1.0, math.erfc(zz / math.sqrt(2))))
    return pd.Series(out, dtype="float64")


def rank_sum_test(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """``ranks.mann_whitney`` with its two-sided p."""
    return ranks.Layout(df, by, score, y).mann_whitney().withColumn("p", rank_sum_p("u", "z", "n", "n_pos", "tied")).drop("tied")
