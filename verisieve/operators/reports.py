"""Whole result jobs: scores from registered sources, their contrasts by category, table and report.

A score source is any function from a session and a folder to rows of (pair, id, method, category,
score). Sources are asked in the order of their names in the call; what a later one says of a pair
and method replaces all that earlier ones say of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.operators import detectors, frames, models, ranks
from verisieve.sources import sinks
from verisieve.sources.tables import written

Source = Callable[[SparkSession, str], DataFrame]

#: The contrasts of a category table (contrast: positive and negative category; fixed values).
CONTRASTS = {"IHvCH": ("IH", "CH"), "IHvCL": ("IH", "CL"), "ILvCH": ("IL", "CH"), "ILvCL": ("IL", "CL")}
CATEGORIES = ("IH", "CH", "IL", "CL")


class ScoreSources:
    """Named score sources."""

    def __init__(self) -> None:
        self._of: dict[str, Source] = {}

    def register(self, name: str) -> Callable[[Source], Source]:
        def put(source: Source) -> Source:
            if name in self._of:
                raise ValueError(f"source {name} is registered twice")
            self._of[name] = source
            return source

        return put

    def names(self) -> list[str]:
        return list(self._of)

    def gather(self, spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
        """pair, id, method, category, score of all sources, or of the named ones, written once."""
        unknown = set(names or []) - set(self._of)
        if unknown:
            raise ValueError(f"unknown score sources: {sorted(unknown)}")
        given = [self._of[n](spark, root).select("pair", "id", "method", "category", F.col("score").cast("double").alias("score"), F.lit(i).alias("_src")) for i, n in enumerate(names or self._of)]
        rows = written(reduce(DataFrame.unionByName, given))
        last = rows.groupBy("pair", "method").agg(F.max("_src").alias("_src"))  # a row for each pair and method
        return rows.join(last, ["pair", "method", "_src"], "left_semi").drop("_src")


def contrast_rows(spark: SparkSession, contrasts: dict[str, tuple[str, str]] = CONTRASTS) -> DataFrame:
    """The table that ``ranks.contrasts`` takes."""
    rows = [(name, c, role, 0) for name, (a, b) in contrasts.items() for c, role in ((a, 1), (b, 0))]
    return spark.createDataFrame(rows, "contrast string, category string, role int, flip int")


def category_table(scores: DataFrame, contrasts: dict[str, tuple[str, str]] = CONTRASTS, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """pair, method, n, n_<category> and an AUROC for each contrast, null where a category has no scored row."""
    keys = ["pair", "method"]
    counts = scores.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories])
    told = ranks.contrasts(scores, contrast_rows(scores.sparkSession, contrasts), keys)
    wide = told.groupBy(*keys).agg(*[F.max(F.when(F.col("contrast") == c, F.col("auroc"))).alias(c) for c in contrasts])
    return counts.join(wide, keys, "left")


def mean_rows(table: DataFrame, values: list[str]) -> DataFrame:
    """One row for each method: the mean of each value over its pairs, and how many pairs there are."""
    return frames.method_means(table, values)


def category_report(table: DataFrame, order: list[str], contrasts: dict[str, tuple[str, str]] = CONTRASTS) -> str:
    """Markdown: the table in the order of pairs, then the means over pairs."""
    values = list(contrasts)
    body = sinks.markdown(frames.in_result_order(table, order), "Contrasts by pair", ["pair", "method", "n", *values])
    means = sinks.markdown(mean_rows(table, values).orderBy("method"), "Means over pairs", ["method", *values, "n_pairs"])
    return f"{body}\n{means}"


def category_job(spark: SparkSession, sources: ScoreSources, root: str, out: str, order: list[str] = (), names: list[str] | None = None) -> str:
    """Gather scores, compute the table once, write it as CSV with four places to ``out``/table and the
    report to ``out``/report; the report is returned."""
    table = written(category_table(sources.gather(spark, root, names)))
    columns = ["pair", "method", "n", *[f"n_{c}" for c in CATEGORIES], *CONTRASTS]
    sinks.write_csv(frames.in_result_order(table, list(order)).coalesce(1), f"{out}/table", columns, 4)
    report = category_report(table, list(order))
    lines = [(i, line) for i, line in enumerate(report.splitlines())]
    spark.createDataFrame(lines, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{out}/report")
    return report


#: The contrast of each band (fixed values): its wrong against its right answers.
BANDS = {"HI": "IHvCH", "LO": "ILvCL"}


def banded(rows: DataFrame, category: str = "category") -> DataFrame:
    """``rows`` of a known category with its band and y, 1 for a wrong answer."""
    c = F.col(category)
    return rows.where(c.isin(*CATEGORIES)).withColumns({"band": F.when(F.substring(c, 2, 1) == "H", "HI").otherwise("LO"), "y": (F.substring(c, 1, 1) == "I").cast("int")})


def specialist_rows(train: DataFrame, test: DataFrame, methods: dict[str, Column], least: int = frames.LEAST["class"], **fit) -> DataFrame:
    """pair, method, band, n_tr_pos, n_tr_neg, n_te_pos, n_te_neg, auroc_specialist: models fitted on one
    band's rows of ``train`` (pair, band, y and what ``methods`` name) and scored on those of ``test``.

    All pairs, methods and bands are fitted in the same passes. Where either class of train or test
    has fewer than ``least`` rows there are counts and no AUROC; rows that lack a method's features
    are no rows of it."""
    keys = ["pair", "method", "band"]
    plain = [df.select("pair", "band", "y", *[x.alias(f"_x{i}") for i, x in enumerate(methods.values())]) for df in (train, test)]
    blocks = {m: F.col(f"_x{i}") for i, m in enumerate(methods)}
    long = [detectors.combinations(df, blocks, {m: (m,) for m in methods}).select("pair", F.col("combo").alias("method"), "band", "y", "x") for df in plain]
    long = [written(df.where(F.col("x").isNotNull() & F.col("y").isNotNull())) for df in long]
    counted = [df.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias(f"n_{n}_pos"), F.count_if(F.col("y") == 0).alias(f"n_{n}_neg")) for df, n in zip(long, ("tr", "te"), strict=True)]
    sizes = ["n_tr_pos", "n_tr_neg", "n_te_pos", "n_te_neg"]
    counts = counted[0].join(counted[1], keys, "full_outer").na.fill(0, sizes)
    ok = written(counts.where(F.least(*sizes) >= least).select(*keys))
    told = models.fit_score(*(frames.restricted(df, ok, keys) for df in long), keys, "x", "y", **fit)
    return counts.join(told.select(*keys, F.col("auroc").alias("auroc_specialist")), keys, "left")


def raw_band_rows(scores: DataFrame, least: int = frames.LEAST["class"]) -> DataFrame:
    """``specialist_rows`` of scores that nothing is fitted for (pair, method, category, score): no training rows."""
    keys = ["pair", "method", "band"]
    told = ranks.guarded(ranks.auroc(banded(scores), keys), least)
    neg = (F.col("n") - F.col("n_pos")).alias("n_te_neg")
    return told.select(*keys, F.lit(0).cast("long").alias("n_tr_pos"), F.lit(0).cast("long").alias("n_tr_neg"), F.col("n_pos").alias("n_te_pos"), neg, F.col("auroc").alias("auroc_specialist"))


def with_generalist(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with auroc_generalist, what ``category_table`` has for the method (by its name without
    a chosen configuration) in the band, and delta; null where either is missing."""
    general = table.select("pair", F.col("method").alias("_base"), F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(c).alias("auroc_generalist")) for b, c in BANDS.items()])))
    named = rows.withColumn("_base", frames.method_name(F.col("method")))
    return named.join(general, ["pair", "_base", "band"], "left").drop("_base").withColumn("delta", F.col("auroc_specialist") - F.col("auroc_generalist"))


def specialist_means(rows: DataFrame) -> DataFrame:
    """band, method, specialist, generalist, delta, n: means over the pairs that have a value, the
    difference of the means, and how many specialists there are."""
    s, g = F.avg("auroc_specialist"), F.avg("auroc_generalist")
    return rows.groupBy("band", "method").agg(s.alias("specialist"), g.alias("generalist"), (s - g).alias("delta"), F.count("auroc_specialist").alias("n"))


def specialist_job(rows: DataFrame, table: DataFrame, out: str) -> str:
    """Rows of specialists with their generalists as CSV in ``out``/specialists; the means are returned as Markdown."""
    told = written(with_generalist(rows, table))
    columns = ["pair", "method", "band", "n_tr_pos", "n_tr_neg", "n_te_pos", "n_te_neg", "auroc_specialist", "auroc_generalist", "delta"]
    sinks.write_csv(told.orderBy("pair", "method", "band").coalesce(1), f"{out}/specialists", columns, 4)
    return sinks.markdown(specialist_means(told).orderBy("band", "method"), "Means over pairs by band", ["band", "method", "specialist", "generalist", "delta", "n"])
