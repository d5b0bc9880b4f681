"""Which candidate stands for an answer, and the labelled examples made of candidates.

``candidates`` has one row for each candidate of a sample: id, candidate, pos, greedy (the
answer given), correct (whether it was judged right), in_pool, alias (a right candidate), s
(its score) and cached (whether states of it are held). Everything is one aggregate by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisieve.functions import text as X


def _best(condition: Column, *order: Column) -> Column:
    """The candidate of the least ``order`` among the rows of ``condition``, as a struct; null without one."""
    row = F.struct("candidate", "s", "cached")
    return F.min_by(F.when(condition, row), F.when(condition, F.struct(*order)))


def _facts(candidates: DataFrame) -> DataFrame:
    same = X.norm(F.col("candidate")) == X.norm(F.col("greedy"))
    loose = X.norm_loose(F.col("candidate")) == X.norm_loose(F.col("greedy"))
    place, hardest = F.col("pos"), [-F.coalesce(F.col("s"), F.lit(float("-inf"))), F.col("pos")]
    return candidates.groupBy("id").agg(
        F.first("correct").alias("correct"),
        _best(F.col("in_pool") & same, place).alias("_exact"),
        _best(F.col("in_pool") & loose, place).alias("_loose"),
        _best(F.col("cached") & (F.col("candidate") == F.col("greedy")), place).alias("_direct"),
        _best(F.col("alias"), *hardest).alias("_alias"),
        _best(~F.col("alias"), *hardest).alias("_hard"),
    )


def _chosen() -> Column:
    """Of the five rules the first that finds a candidate, with its name."""
    rules = (("_exact", "exact"), ("_loose", "loose"), ("_direct", "exact"))
    named = lambda c, kind: F.when(F.col(c).isNotNull(), F.struct(f"{c}.*", F.lit(kind).alias("kind")))
    last = F.when(F.col("correct"), named("_alias", "gt_fallback")).otherwise(named("_hard", "hardest_distractor_fallback"))
    return F.coalesce(*[named(*r) for r in rules], last)


def match_greedy(candidates: DataFrame) -> DataFrame:
    """id, candidate, s, cached, kind: the candidate that stands for the answer given. It is the
    first of the pool that equals it, or does so without quotes; the answer itself where states
    of it are held; the best alias of a right answer; the hardest other candidate of a wrong one."""
    return _facts(candidates).withColumn("_c", _chosen()).where("_c IS NOT NULL").select("id", "correct", "_c.*")


def labelled_examples(candidates: DataFrame) -> DataFrame:
    """part, id, candidate, s, kind, y. Part ``pair``: the best alias (y 0) and a wrong candidate
    (y 1: the answer given if it is wrong and states of it are held, else the hardest). Part
    ``greedy``: the row of ``match_greedy``, y telling a wrong answer. A sample whose pair lacks
    states of either has no rows at all; a greedy row that lacks them is left out."""
    wrong = F.when(~F.col("correct") & F.col("_direct").isNotNull(), F.col("_direct")).otherwise(F.col("_hard"))
    rows = _facts(candidates).select("id", "correct", F.col("_alias").alias("a"), wrong.alias("b"), _chosen().alias("g")).where("a.cached AND b.cached")
    out = lambda part, c, kind, y: F.struct(F.lit(part).alias("part"), F.col(f"{c}.candidate").alias("candidate"), F.col(f"{c}.s").alias("s"), kind.alias("kind"), y.cast("int").alias("y"))
    none = F.lit(None).cast("string")
    made = [out("pair", "a", none, F.lit(0)), out("pair", "b", none, F.lit(1)), F.when(F.col("g.cached"), out("greedy", "g", F.col("g.kind"), ~F.col("correct")))]
    return rows.select("id", F.inline(F.array_compact(F.array(*made))))


def layer_states(keys: DataFrame, states: DataFrame, layers: list[int], key: list[str]) -> DataFrame:
    """``keys`` with states: an array of the vectors of ``layers`` in order; keys that lack one are left out."""
    held = states.where(F.col("layer").isin(layers)).join(keys.select(*key).distinct(), key, "left_semi")
    got = held.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("layer", "vector"))).alias("_m")).where(F.size("_m") == len(set(layers)))
    return keys.join(got, key).withColumn("states", F.array(*[F.col("_m")[n] for n in layers])).drop("_m")
