"""Selection, sampling, lookups and set operations, with every tie order explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verisieve.operators.running import running


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def argmax(df: DataFrame, by: list[str], value: str, ordinal: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the row of the largest value, the smallest ordinal of ties; nulls lose. One aggregate, combined before the shuffle."""
    key = F.struct(F.coalesce(F.col(value), F.lit(float("-inf"))), -F.col(ordinal))
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), key).alias("_b")).select(*by, "_b.*")


def seeded(*parts: Column | str) -> Column:
    """A portable random order: md5 of a seed and a key."""
    return F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _seeded_ranks(df: DataFrame, strata: list[str], key: str, seed: str, sized: bool = True) -> DataFrame:
    """``df`` with _rank (from 1) in seeded order within each stratum, and the stratum's _size."""
    rows = df.withColumn("_md5", seeded(F.lit(seed), F.col(key))).withColumn("_1", F.lit(1))
    return running(rows, strata, ["_md5", key], {"_rank": "_1"}, wholes={"_size": "_1"} if sized else None).drop("_md5", "_1")


def stratified_split(df: DataFrame, strata: list[str], key: str, share: float, seed: str) -> DataFrame:
    """Column is_test: half-even ``share`` of each stratum, in seeded order."""
    ranked = _seeded_ranks(df, strata, key, seed)
    return ranked.withColumn("is_test", F.col("_rank") <= F.bround(F.lit(share) * F.col("_size"))).drop("_rank", "_size")


def stratified_folds(df: DataFrame, strata: list[str], key: str, folds: int, seed: str) -> DataFrame:
    ranked = _seeded_ranks(df, strata, key, seed, sized=False)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def balanced_sample(df: DataFrame, category: str, key: str, wanted: int, n_categories: int, seed: str) -> DataFrame:
    """At most wanted // n_categories rows of each category, in seeded order."""
    ranked = _seeded_ranks(df.where(F.col(category).isNotNull()), [category], key, seed, sized=False)
    return ranked.where(F.col("_rank") <= wanted // n_categories).drop("_rank")


def missing_anywhere(required: DataFrame, present: DataFrame, key: list[str], part: str) -> DataFrame:
    """Keys that lack at least one required part."""
    return required.join(present, [*key, part], "left_anti").select(*key).distinct()


def pending(source: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows that are still to be processed."""
    return source.join(done.select(*key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def union_by_priority(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which a later source wins on an equal key."""
    tagged = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return first_by(out, key, F.desc("_src")).drop("_src")


def compare_tables(a: DataFrame, b: DataFrame, key: list[str], value: str, tolerance: float = 5e-4) -> DataFrame:
    """Rows of either table with status: same, differs, only_left, only_right; one null is a difference."""
    l, r = a.select(*key, F.col(value).alias("left_value"), F.lit(True).alias("_l")), b.select(*key, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    x, y = F.col("left_value"), F.col("right_value")
    differs = (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    status = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(differs, "differs").otherwise("same")
    return l.join(r, key, "full_outer").withColumn("status", status).drop("_l", "_r")


def validation(compared: DataFrame) -> DataFrame:
    """n, differing, passed of ``compare_tables``: passed where every row is the same."""
    bad = F.count_if(F.col("status") != "same")
    return compared.agg(F.count("*").alias("n"), bad.alias("differing"), (bad == 0).alias("passed"))


def require_valid(compared: DataFrame) -> None:
    """An error that names some of the differing rows, if there are any."""
    wrong = compared.where("status <> 'same'").limit(10).collect()
    if wrong:
        raise ValueError(f"tables differ: {[r.asDict() for r in wrong]}")
