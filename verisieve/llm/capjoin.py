"""Cosine self-join of vectors by spherical-cap filters.

The vectors of a label and length are a class. Its filters are the directions of a structured random
product code: the space is turned at random and cut in two halves, each half has ``B`` random unit
words, and a direction is a pair of words, so B * B directions cost 2 * B inner products. A vector
is list-decoded to the ``FILTERS`` directions with the largest inner products, the caps that it lies
deepest in, exactly: they are among the pairs of the best words of both halves. Vectors that share
a filter are compared in double precision; a pair counts in the smallest filter that it shares.

B grows with the class, so that a vector meets about ``ONE`` others however many there are. A class of
up to ``ONE`` vectors has one direction, which all exceed: there nothing can be lost. In larger ones
a pair of the wanted similarity is lost if none of the 24 best directions of one is among those of
the other; how seldom that is the README says (a test holds it at 16 and 256 dimensions).

Ids are dealt to filters; what is compared is known before a vector is fetched. Equal vectors of a
label are compared once, with their number. Filters of many vectors are dealt into blocks of bounded
size, and each task gives one row for each vector: its number of links there and a link to the first
vector that it is joined with, never the pairs. The codes follow from the seed, nothing is sampled,
collected or broadcast.

A vector that is null, empty, zero, or holds null or non-finite components, and one of
null label, links with nothing. Vectors of different lengths do not link. Rows of equal
vec_id are separate vectors that share an id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.blocks import deal, groups, least_labels, spread
from verisieve.llm.common import stash, table, tune
from verisieve.llm.components import components
from verisieve.operators.running import with_totals

#: Directions that a vector is dealt to.
FILTERS = 24
#: Vectors of a class that one direction holds, and that a vector meets in larger classes, about.
ONE = 4096
#: Components that are turned together.
TURNED = 1024


def _units(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=8)
def _turn(width: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random order of the components, and random rotations of stretches of them."""
    r = np.random.default_rng([seed, width])
    return r.permutation(width), [np.linalg.qr(r.standard_normal((n, n)))[0] for n in (min(TURNED, width - at) for at in range(0, width, TURNED))]


class ProductCode:
    """Directions that are pairs of words, one for each half of the turned space."""

    def __init__(self, width: int, words: int, seed: int = 42):
        self.width, self.words, self.seed = width, words, seed
        r = np.random.default_rng([seed, width, words])
        self.half = width // 2
        self.books = [self._unit(r.standard_normal((words, n))) for n in (self.half, width - self.half)]

    @staticmethod
    def _unit(c: np.ndarray) -> np.ndarray:
        return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)

    def decode(self, unit: np.ndarray, most: int = FILTERS) -> np.ndarray:
        """Each row's directions of the largest inner products, as ascending numbers."""
        order, turns = _turn(self.width, self.seed)
        y = unit[:, order]
        y = np.concatenate([y[:, at * TURNED : at * TURNED + len(t)] @ t for at, t in enumerate(turns)], axis=1)
        best, words = [], []
        top = min(most, self.words)
        for part, book in zip((y[:, : self.half], y[:, self.half :]), self.books, strict=True):
            s = part @ book.T
            w = np.argpartition(-s, top - 1, axis=1)[:, :top]
            best.append(np.take_along_axis(s, w, 1))
            words.append(w)
        sums = (best[0][:, :, None] + best[1][:, None, :]).reshape(len(unit), -1)
        pairs = (words[0][:, :, None] * self.words + words[1][:, None, :]).reshape(len(unit), -1)
        most = min(most, sums.shape[1])
        at = np.argpartition(-sums, most - 1, axis=1)[:, :most]
        return np.sort(np.take_along_axis(pairs, at, 1), axis=1)


def words_for(vectors: int) -> int:
    """Words of a half for a class of so many vectors."""
    return 1 if vectors <= ONE else ceil(FILTERS * sqrt(vectors / ONE))


def first_shared(lists: np.ndarray, here: int, hit: np.ndarray) -> np.ndarray:
    """Pairs of ``hit`` that share no direction before ``here``; ``lists`` are the rows' directions."""
    values, at, times = np.unique(lists, return_inverse=True, return_counts=True)
    at = at.reshape(lists.shape)
    keep = (lists < here) & (times[at] > 1)
    if not keep.any():
        return hit
    used, column = np.unique(at[keep], return_inverse=True)
    held = np.zeros((len(lists), len(used)), np.float32)
    held[np.nonzero(keep)[0], column] = 1
    return hit & ~(held @ held.T > 0)


def link_vectors(vectors: DataFrame, similarity: float = 0.98, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    tune(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    # copies: one row for each label and vector, numbered where it is written
    same = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    reps = stash(same.withColumn("width", F.size("v")).withColumn("gid", F.monotonically_increasing_id()))
    sized = with_totals(reps.withColumn("_1", F.lit(1)), ["label", "width"], {"n": "_1"})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int], ProductCode] = {}
        for batch in batches:
            keys = [(w, words_for(n)) for w, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            for key in sorted(set(keys)):
                part = batch.filter(pa.array([k == key for k in keys]))
                if key not in codes:
                    codes[key] = ProductCode(*key)
                for a in range(0, part.num_rows, 256):
                    some = part.slice(a, 256)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(codes[key].decode(_units(some.column(3)))), pa.list_(pa.int64()))], ["gid", "filters"])

    placed = sized.select("gid", "width", "n", "v").mapInArrow(place, "gid long, filters array<long>")
    members = stash(reps.join(placed, "gid"))
    cell = ["label", "width", "cell"]
    tasks = deal(members.select("label", "width", "gid", F.explode("filters").alias("cell")), cell, "gid", block)
    tasks = tasks.join(members.select("gid", "rep", "m", "v", "filters"), "gid").select(*cell, "block_i", "block_j", "side", "gid", "rep", "m", "v", "filters")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, 5):
            out: list[list[np.ndarray]] = []
            here, i, j, side, gid, rep, m = (t.column(n).to_numpy() for n in ("cell", "block_i", "block_j", "side", "gid", "rep", "m"))
            for a, b in zip(at[:-1], at[1:], strict=True):
                x = _units(t.column("v").slice(a, b - a).combine_chunks())
                hit = x @ x.T >= similarity
                np.fill_diagonal(hit, False)
                if i[a] != j[a]:
                    hit &= side[a:b, None] != side[None, a:b]
                some = np.flatnonzero(hit.any(axis=1))
                if not len(some):
                    continue
                hit = hit[np.ix_(some, some)]
                lists = t.column("filters").slice(a, b - a).combine_chunks()
                lists = lists.flatten().to_numpy().reshape(b - a, -1)[some]
                found = first_shared(lists, here[a], hit) @ m[a + some].astype(np.float64)
                out.append([gid[a + some], rep[a + some], found.astype(np.int64), rep[a + some][least_labels(hit)]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["gid", "rep", "links", "first"])

    linked = stash(spread(tasks, cell).mapInArrow(compare, "gid long, rep long, links long, first long"))
    counts = linked.groupBy("gid").agg(F.sum("links").alias("links"))
    found = components(linked.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    # written, so that rows of one very common vector can be split between tasks of the join
    known = stash(
        reps.select("gid", "label", "v", "rep", "m").join(counts, "gid", "left").join(found, F.col("rep") == F.col("node"), "left")
        .select("label", "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    good = rows.where("sound").join(known, ["label", "v"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_cap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), walk AS (
  WITH RECURSIVE w(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT w.a, l.b FROM w JOIN links l ON w.b = l.a)
  SELECT a, min(b) AS c FROM w GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, w.c AS component_id, e.vec_id = w.c AS kept
FROM embeddings e JOIN walk w ON w.a = e.vec_id
"""
