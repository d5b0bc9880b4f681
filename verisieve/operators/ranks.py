"""Ranked statistics over labelled scores: y is 1 for the positive class.

Rows with a null or NaN score, or a null label, are not scored. Rows are summed to steps, one for
each distinct score of a group, and the steps are written once, by ranges of (group, score), with
what lies below them (``Layout``). Every statistic is an aggregate of that table, so several of
them cost one evaluation of the input, and one group of any size is shared between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisieve.operators.running import running, with_totals
from verisieve.sources.tables import written


def scored(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Rows with a usable score and label."""
    value = F.col(score).cast("double")
    return df.where(value.isNotNull() & ~F.isnan(value) & F.col(y).isNotNull())


def steps_of(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """One row for each distinct score: _s, _p positives, _n rows, _neg negatives."""
    value = F.col(score).cast("double")
    # adding zero makes -0.0 the number 0.0
    steps = scored(df, score, y).groupBy(*by, (value + F.lit(0.0)).alias("_s")).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n"))
    return steps.withColumn("_neg", F.col("_n") - F.col("_p"))


class Layout:
    """Steps of scored rows: ``by``, _s, _p, _n, _neg, and of lower scores _b negatives and _a rows;
    _w is the pairs that the step's positives win, half of each tie."""

    def __init__(self, df: DataFrame, by: list[str], score: str = "score", y: str = "y"):
        self.by = by
        steps = written(steps_of(df, by, score, y))
        at = running(steps, by, ["_s"], {"_b": "_neg", "_a": "_n"}, rows=steps.count())
        self.steps = at.withColumns({"_b": F.col("_b") - F.col("_neg"), "_a": F.col("_a") - F.col("_n")}).withColumn("_w", F.col("_p") * (F.col("_b") + F.col("_neg") / 2.0))

    def auroc(self) -> DataFrame:
        """Tie-corrected AUROC for each group: n, n_pos, auroc; null where one class is missing."""
        pos, neg = F.sum("_p"), F.sum("_neg")
        return self.steps.groupBy(*self.by).agg(F.sum("_n").alias("n"), pos.alias("n_pos"), F.when((pos > 0) & (neg > 0), F.sum("_w") / (pos * neg)).alias("auroc"))

    def average_precision(self) -> DataFrame:
        """Mean precision at the positives, scores descending, ties together."""
        whole = with_totals(self.steps, self.by, {"_rows": "_n", "_pos": "_p"})
        right = F.col("_pos") - (F.col("_a") - F.col("_b"))  # all but the positives below
        return whole.groupBy(*self.by).agg((F.sum(F.col("_p") * right / (F.col("_rows") - F.col("_a"))) / F.nullif(F.sum("_p"), F.lit(0))).alias("average_precision"))

    def mann_whitney(self) -> DataFrame:
        """u, z (normal, with tie and continuity correction), n, n_pos and tied (whether scores repeat)
        of each cell; z is null where all are equal."""
        out = self.steps.groupBy(*self.by).agg(F.sum("_w").alias("u"), F.sum("_n").alias("n"), F.sum("_p").cast("long").alias("n_pos"), F.sum(F.pow("_n", F.lit(3)) - F.col("_n")).alias("_t"), (F.max("_n") > 1).alias("tied"))
        a, n = F.col("n_pos"), F.col("n")
        b = n - a
        var = a * b / 12.0 * ((n + 1) - F.col("_t") / (n * (n - 1)))
        return out.withColumn("z", F.when(var > 0, (F.greatest(F.abs(F.col("u") - a * b / 2.0) - 0.5, F.lit(0.0))) / F.sqrt(var))).drop("_t")


def auroc(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """``Layout.auroc`` of one score."""
    return Layout(df, by, score, y).auroc()


def contrasts(df: DataFrame, dim: DataFrame, by: list[str], category: str = "category", score: str = "score") -> DataFrame:
    """AUROC of every contrast in one pass. ``dim`` has contrast, category, role (1: positive), flip
    (report 1 - AUROC); it is a small fixed table."""
    rows = df.join(F.broadcast(dim), category)
    out = auroc(rows.withColumn("_y", F.col("role")), [*by, "contrast", "flip"], score, "_y")
    return out.withColumn("auroc", F.when(F.col("flip") == 1, 1 - F.col("auroc")).otherwise(F.col("auroc"))).drop("flip")


def guarded(df: DataFrame, least: int, value: str = "auroc") -> DataFrame:
    """``value`` only where both classes have at least ``least`` rows (columns n, n_pos)."""
    return df.withColumn(value, F.when(F.least(F.col("n_pos"), F.col("n") - F.col("n_pos")) >= least, F.col(value)))


def confusion(df: DataFrame, by: list[str], p: str = "p", y: str = "y", cut: float = 0.5) -> DataFrame:
    """n, n_wrong, accuracy, precision, recall, f1 of class 1; empty ratios are 0."""
    hat = (F.col(p) >= cut).cast("long")
    tp, fp, fn = F.sum(hat * F.col(y)), F.sum(hat * (1 - F.col(y))), F.sum((1 - hat) * F.col(y))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("n_wrong"), F.avg((hat == F.col(y)).cast("double")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auarc(df: DataFrame, by: list[str], uncertainty: str, correct: str, tie: str) -> DataFrame:
    """Area under the accuracy-rejection curve: the mean of the accuracies of the least uncertain k."""
    rows = df.select(*by, F.col(uncertainty).alias("_u"), F.col(tie).alias("_t"), F.col(correct).cast("double").alias("_c"), F.lit(1).alias("_1"))
    at = running(rows, by, ["_u", "_t"], {"_right": "_c", "_k": "_1"})
    return at.groupBy(*by).agg(F.avg(F.col("_right") / F.col("_k")).alias("auarc"))


def average_precision(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """``Layout.average_precision`` of one score."""
    return Layout(df, by, score, y).average_precision()


def mann_whitney(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """``Layout.mann_whitney`` of one score, without ``tied``."""
    return Layout(df, by, score, y).mann_whitney().drop("tied")


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """Column q: false-discovery-adjusted p."""
    ranked = running(df.withColumn("_1", F.lit(1)), by, [p, tie], {"_k": "_1"}, wholes={"_m": "_1"})
    scaled = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_k"))
    least = running(scaled, by, [p, tie], mins={"q": "_q"}, reverse=True)
    return least.withColumn("q", F.least(F.lit(1.0), "q")).drop("_1", "_k", "_m", "_q")


def discoveries(df: DataFrame, by: list[str], q: str = "q", level: float = 0.05) -> DataFrame:
    """n, below and share of the tests whose adjusted p is under ``level``."""
    hit = (F.col(q) < level).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(q) < level).alias("below"), F.avg(hit).alias("share"))
