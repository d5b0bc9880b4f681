"""Joins by id, sets of keys, guards and the shaping of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisieve.operators import vectors
from verisieve.operators.running import running


def common_rows(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first frame whose ids every frame has, with the columns of all. Of rows of one id
    in a later frame the smallest counts, so that ids do not multiply."""

    def once(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        if not rest:
            return df.distinct()
        return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_least")).select(*key, "_least.*")

    return reduce(lambda a, b: a.join(once(b), key), frames)


def key_union(frames: list[DataFrame], key: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(*key) for f in frames]).distinct()


def key_intersection(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_semi")


def key_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key), key, "left_anti")


def attach(df: DataFrame, lookup: DataFrame, key: list[str], defaults: dict[str, object]) -> DataFrame:
    """``df`` with columns of ``lookup`` (one row for each key), their defaults where no row or a
    null is found, and ``matched``: whether a row was."""
    found = lookup.select(*key, *defaults).withColumn("matched", F.lit(True))
    out = df.join(found, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None})


def attach_scores(examples: DataFrame, scores: DataFrame, key: list[str], methods: list[str]) -> DataFrame:
    """A column for each method from long (key, method, score) rows; null where a row is missing."""
    wide = scores.where(F.col("method").isin(methods)).groupBy(*key).agg(*[F.max(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in methods])
    return examples.join(wide, key, "left")


def restricted(df: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is among ``ids``."""
    return df.join(ids.select(*key), key, "left_semi")


def grid(spark: SparkSession, models: list[str], datasets: list[str], only: list[str] | None = None) -> DataFrame:
    """model, dataset, pair and ord of every combination, or of the named pairs; a configured few."""
    rows = [(m, d, f"{m}_{d}") for m in models for d in datasets]
    unknown = set(only or []) - {p for *_, p in rows}
    if unknown:
        raise ValueError(f"unknown pairs: {sorted(unknown)}")
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows) if not only or r[2] in only], "model string, dataset string, pair string, ord int")


def names_of(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The distinct names in a column of a configuration table, sorted; more than ``most`` are an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} names in {column}")
    return sorted(found)


def argmax_columns(df: DataFrame, columns: list[str], name: str = "best", value: str = "value") -> DataFrame:
    """Name and value of the largest of ``columns``, the earlier of equals; null and NaN never win,
    and both are null where there is nothing else."""
    some = F.array(*[F.struct(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("v"), F.lit(-i).alias("o"), F.lit(c).alias("n")) for i, c in enumerate(columns)])
    top = F.array_max(F.filter(some, lambda x: x["v"].isNotNull()))
    return df.withColumn("_top", top).withColumn(name, F.col("_top.n")).withColumn(value, F.col("_top.v")).drop("_top")


def placed_results(df: DataFrame, order: list[str], pair: str = "pair", method: str = "method") -> DataFrame:
    """Column place: the row's number, from 1, in the order of ``in_result_order``; the sorted table is
    numbered range by range."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(pair))
    ranked = df.withColumns({"_at": F.when(place > 0, place).otherwise(F.lit(1 << 30)), "_1": F.lit(1)})
    return running(ranked, [], ["_at", pair, method], {"place": "_1"}).drop("_at", "_1")


def in_result_order(df: DataFrame, order: list[str], pair: str = "pair", method: str = "method") -> DataFrame:
    """Sorted by the place of the pair in ``order`` (others last), then by method."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(pair))
    return df.orderBy(F.when(place > 0, place).otherwise(F.lit(1 << 30)), pair, method)


def method_name(method: Column) -> Column:
    """A method's name without the note of its chosen configuration, `` (best=...)``."""
    return F.substring_index(method, " (best=", 1)


def method_means(df: DataFrame, values: list[str], method: str = "method") -> DataFrame:
    """Mean over pairs of each value by canonical method, without nulls and NaN."""
    usable = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.groupBy(method_name(F.col(method)).alias(method)).agg(*[F.avg(usable(c)).alias(c) for c in values], F.count("*").alias("n_pairs"))


def rounded_means(df: DataFrame, by: list[str], values: list[str], places: int = 4) -> DataFrame:
    return df.groupBy(*by).agg(*[F.round(F.avg(c), places).alias(c) for c in values])


def complete_rows(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows in which none of ``needed`` is null."""
    return df.na.drop(subset=needed)


def usable_rows(df: DataFrame, text: str | None = None, answers: str | None = None, category: str | None = None, least: int = 2, unknown: str = "?") -> DataFrame:
    """Rows with text in ``text``, at least ``least`` non-empty ``answers``, and a known ``category``."""
    if text:
        df = df.where(F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("")) != "")
    if answers:
        df = df.where(F.size(F.filter(F.coalesce(F.col(answers), F.array().cast("array<string>")), lambda a: F.coalesce(F.regexp_replace(a, r"^\s+|\s+$", ""), F.lit("")) != "")) >= least)
    if category:
        df = df.where(F.col(category).isNotNull() & (F.col(category) != unknown))
    return df


#: Fewest rows that a result is reported for.
LEAST = {"train_ids": 30, "test_ids": 20, "band": 5, "pairs": 10, "cell": 5, "class": 20}


def enough(df: DataFrame, least: dict[str, str], values: list[str]) -> DataFrame:
    """``values`` only where every count column reaches its guard (count column: name in ``LEAST``)."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= LEAST[g], F.lit(False)) for c, g in least.items()])
    return df.withColumns({v: F.when(ok, F.col(v)) for v in values})


def pooled_verdict(means: DataFrame, mine: str, other: str, targets: list[str], guards: list[str], slack: float = 0.01) -> DataFrame:
    """One row: the differences of two methods' means and ``passed``: a target gains and no guard loses over ``slack``."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    row = means.agg(*[(pick(mine, c) - pick(other, c)).alias(c) for c in [*targets, *guards]])
    gains = reduce(lambda a, b: a | b, [F.col(c) > 0 for c in targets])
    holds = reduce(lambda a, b: a & b, [F.col(c) >= -slack for c in guards])
    return row.withColumn("passed", F.coalesce(gains & holds, F.lit(False)))


def shard(df: DataFrame, order: list[str], number: int, of: int) -> DataFrame:
    """Every ``of``-th row of the whole table in the order of ``order``, from row ``number``."""
    at = running(df.withColumn("_1", F.lit(1)), [], order, {"_at": "_1"})
    return at.where(F.pmod(F.col("_at") - 1, F.lit(of)) == number).select(*df.columns)


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an explicit order, for trial runs."""
    return df.orderBy(*order).limit(n)


def sized_sample(df: DataFrame, category: str, key: str, wanted: int, seed: str) -> DataFrame:
    """``relational.balanced_sample`` with the table's own number of categories, null among them; a
    table of at most ``wanted`` rows passes whole."""
    from verisieve.operators import relational as rel

    facts = df.agg((F.countDistinct(category) + F.max(F.col(category).isNull().cast("int"))).alias("k"), F.count("*").alias("n")).first()
    return df if facts.n <= wanted else rel.balanced_sample(df, category, key, wanted, facts.k, seed)


def least_length(df: DataFrame, by: list[str], values: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.size(values)).alias("least"))


def sanity(df: DataFrame, by: list[str], values: str) -> DataFrame:
    """finite, constant, least, most, mean and deviation of all elements of an array column; the
    statistics are of the finite ones. Each array is summed where it is, then the sums are."""
    v = F.transform(F.col(values), lambda x: x.cast("double"))
    good = F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.size(values) > 0).select(*by, good.alias("_v"), (F.size(good) == F.size(values)).alias("_ok"))
    n, total = F.size("_v").cast("double"), F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"_n": n, "_m": F.when(n > 0, total / n)})
    rows = rows.withColumn("_q", F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))))
    least, most, mean = F.min(F.array_min("_v")), F.max(F.array_max("_v")), F.sum(F.col("_n") * F.col("_m")) / F.nullif(F.sum("_n"), F.lit(0.0))
    squares = F.sum("_q") + F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - F.sum("_n") * mean * mean
    return rows.groupBy(*by).agg(F.bool_and("_ok").alias("finite"), (least == most).alias("constant"), least.alias("least"), most.alias("most"), mean.alias("mean"), F.sqrt(F.greatest(squares / F.nullif(F.sum("_n"), F.lit(0.0)), F.lit(0.0))).alias("deviation"))


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """The distinct values with the place where each is first seen."""
    return df.groupBy(value).agg(F.min(order).alias("seen_at"))


def merged(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Nested upsert of (key, map) rows: a new entry of a map wins, other entries stay."""
    a, b = old.select(key, F.col(value).alias("_a")), new.select(key, F.col(value).alias("_b"))
    empty = F.create_map().cast(old.schema[value].dataType)
    kept = F.map_filter(F.coalesce("_a", empty), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("_b", empty)), k))
    return a.join(b, key, "full_outer").select(key, F.map_concat(kept, F.coalesce("_b", empty)).alias(value))


def dimension_stats(df: DataFrame, by: list[str], vector: str, floor: float = 1e-6) -> DataFrame:
    """``vectors.mean_and_deviation`` with a row for each component: by, dim, mu, sigma."""
    stats = vectors.mean_and_deviation(df, by, vector, floor)
    cells = F.transform("mu", lambda m, i: F.struct(i.alias("dim"), m.alias("mu"), F.get("sigma", i).alias("sigma")))
    return stats.select(*by, F.inline(cells))


def vector_mean(df: DataFrame, by: list[str], vector: str, out: str = "mean") -> DataFrame:
    """Component-wise mean of the vectors of a group."""
    return vectors.vector_stats(df, by, vector).select(*by, F.col("mean").alias(out))


def bucket_vector(states: DataFrame, stats: DataFrame, buckets: dict[str, list[int]], key: list[str], log_prob: str) -> DataFrame:
    """key, x: for each bucket of layers the mean of the z-scored vectors, one after another, then
    the log probability: 2 D + 1 numbers for two buckets of width D.

    ``states`` has key, layer, vector and ``log_prob``; ``stats`` layer (and columns of the key), mu,
    sigma. Keys that lack a layer of a bucket are left out."""
    from verisieve.functions import arrays as A

    wanted = sorted({n for layers in buckets.values() for n in layers})
    z = states.where(F.col("layer").isin(wanted)).join(stats, [c for c in stats.columns if c not in ("mu", "sigma")])
    z = z.select(*key, "layer", F.col(log_prob).cast("double").alias("_lp"), A.zscore(F.col("vector"), F.col("mu"), F.col("sigma")).alias("_z"))
    rows = z.groupBy(*key).agg(F.first("_lp").alias("_lp"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "_z")))).alias("_m")).where(F.size("_m") == len(wanted))

    def mean_of(layers: list[int]) -> Column:
        vectors = [F.col("_m")[n] for n in layers]
        return F.transform(reduce(A.add, vectors), lambda v: v / len(layers))

    return rows.select(*key, F.concat(*[mean_of(layers) for layers in buckets.values()], F.array("_lp")).alias("x"))


def listed(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "x") -> DataFrame:
    """Arrays of a group's rows one after another in the order of ``order``."""
    kind = df.schema[value].dataType
    one = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda c: c["_v"])
    return df.groupBy(*by).agg((F.flatten(one) if isinstance(kind, T.ArrayType) else one).alias(out))
