"""Near-duplicate documents by DartMinHash signatures, banding and exact checks.

Every element of a weighted set owns a fixed Poisson process of darts over
(weight, rank); cells of that plane are drawn from hashes of the element and the cell,
so darts are alike in every set that holds the element. A set throws the darts below its
elements' weights up to a rank that gives about ``k (ln k + 3)`` darts in all, each dart
falls to one of ``k`` coordinates, and the earliest of each coordinate is kept. Sets
with an empty coordinate throw on up to twice the rank, until none is empty. Two sets
agree in a coordinate with the probability of their weighted Jaccard similarity.

Documents are sets of five-word shingles weighted by their counts (without ``weighted``
all weigh 1); all of a shorter document's words are one shingle. Documents of equal words
(equal SHA-256) are one text. Texts that share a band are candidates. Each is first
compared, by its exact weighted Jaccard similarity, with the first of its band; bands that
then still span several components are compared throughout in blocks of bounded size,
where only pairs of one component, and pairs whose sizes rule the similarity out, are
passed over. So no candidate that links different texts is lost and no group is expanded
into all its pairs. A pair at exactly 0.8 meets in a band with probability 0.998.

Null and empty texts have no words and are copies of each other. Rows of one doc_id, or of
a null one, are separate documents; a class of null ids alone has a null class_id. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.blocks import deal, groups, spread
from verisieve.llm.common import fresh_name, stash, table, tune
from verisieve.llm.components import components
from verisieve.llm.textvec import BASE, digests, mix, pieces, plain_words, powers, span_hash, words

U = np.uint64
#: Rank cells: [0, 2**LOW), then doubling.
LOW = -6
_poisson: dict[float, np.ndarray] = {}


def _counts(area: float, u: np.ndarray) -> np.ndarray:
    """Poisson counts of mean ``area`` at the uniform numbers ``u``."""
    if area not in _poisson:
        p = exp(-area)
        total, n, cdf = p, 0, []
        while total < 1 - 1e-12 and n < 10 * area + 50:
            cdf.append(total)
            n += 1
            p *= area / n
            total += p
        _poisson[area] = np.array([*cdf, 1.0])
    return np.searchsorted(_poisson[area], u, "right")


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _cells(theta: float) -> int:
    """Rank cells needed to cover [0, theta)."""
    return 1 if theta <= 2.0**LOW else 1 + int(np.ceil(np.log2(theta) - LOW))


def _rank_cell(j: int) -> tuple[float, float]:
    return (0.0, 2.0**LOW) if j == 0 else (2.0 ** (LOW + j - 1), 2.0 ** (LOW + j))


def signatures(elements: np.ndarray, weights: np.ndarray | None, bounds: np.ndarray, k: int) -> np.ndarray:
    """uint32 signatures (sets x k) of the sets elements[bounds[i]:bounds[i+1]]; the empty set gives zeros.

    ``weights`` are positive; None means 1 for all.
    """
    n = len(bounds) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    total = size.astype(np.float64) if weights is None else np.bincount(owner, weights, n)
    none = np.iinfo(np.uint64).max
    best = np.full(n * k, none, U)
    theta = np.where(total > 0, k * (log(k) + 3) / np.maximum(total, 1e-300), 0.0)
    done = np.zeros(n)  # ranks already covered
    live = size > 0
    # weight cells: [0, 1), [1, 2), [2, 4) ... ; with unit weights only the first
    top = 1 if weights is None or not len(weights) else 1 + int(np.ceil(np.log2(max(1.0, float(weights.max())))))
    while live.any():
        reach = float(theta[live].max())
        for v in range(top):
            w_lo, w_hi = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0**v)
            able = live[owner] if weights is None or not v else live[owner] & (weights > w_lo)
            able = np.flatnonzero(able)
            until, since = theta[owner[able]], done[owner[able]]
            for j in range(_cells(reach)):
                r_lo, r_hi = _rank_cell(j)
                at = able[(until > r_lo) & (since < r_hi)]
                if not len(at):
                    continue
                seed = mix(elements[at] ^ U((v * 64 + j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
                darts = _counts((w_hi - w_lo) * (r_hi - r_lo), unit(seed))
                some = darts > 0
                at, seed, darts = at[some], seed[some], darts[some]
                who = np.repeat(at, darts)
                number = np.arange(len(who)) - np.repeat(np.cumsum(darts) - darts, darts)
                h = mix(np.repeat(seed, darts) + number.astype(U) * U(0xD1B54A32D192ED03) + U(1))
                rank = r_lo + unit(h) * (r_hi - r_lo)
                doc = owner[who]
                fell = (rank < theta[doc]) & (rank >= done[doc])
                h2 = mix(h ^ U(0xA5A5A5A5DEADBEEF))
                if weights is not None:
                    fell &= w_lo + unit(mix(h2 ^ U(0x5851F42D4C957F2D))) * (w_hi - w_lo) < weights[who]
                doc, rank, h2 = doc[fell], rank[fell], h2[fell]
                slot = doc * k + (h2 % U(k)).astype(np.int64)
                # rank as a fixed share of the set's reach orders darts within the set
                order = (rank * total[doc] * 2.0**14).astype(np.uint64) << U(32)
                np.minimum.at(best, slot, order | (h2 >> U(32)))
        empty = (best.reshape(n, k) == none).any(axis=1)
        done = np.where(live, theta, done)
        live &= empty
        theta = np.where(live, 2 * theta, theta)
    best[best == none] = 0
    return best.astype(np.uint32).reshape(n, k)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, bounds): sorted distinct shingles of each row."""
    n = len(off) - 1
    _, _, h, to = words(buf, off)
    size = np.diff(to)
    code = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(BASE, len(h)), out=code[1:])
    count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    first = np.repeat(to[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = np.repeat(np.arange(n), count)
    s = span_hash(code, first, np.minimum(first + width, to[owner + 1]))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(owner[at], np.arange(n + 1))


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def text_keys(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each row's words."""
    plain, at = plain_words(buf, off)
    return digests(plain, at[:-1], at[1:])


def sketch(docs: DataFrame, bands: int, rows: int, width: int, weighted: bool) -> DataFrame:
    """row (a number), doc_id, t1, t2 (key of the words), n (shingles), bands, signature.

    The row numbers hold only in one run: stash the result."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                s, c, bounds = shingle_sets(buf, off, width)
                key = text_keys(buf, off)
                sig = signatures(s, c.astype(np.float64) if weighted else None, bounds, k)
                band = np.full((hi - lo, bands), 0x2545F4914F6CDD1D, U) + np.arange(bands, dtype=U)
                for r in range(rows):
                    band = mix(band ^ sig[:, r::rows].astype(U)) if r else mix(band + sig[:, r::rows].astype(U))
                ends = np.arange(hi - lo + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + ends[:-1]), batch.column(0).slice(lo, hi - lo), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(np.diff(bounds)), _lists(band.view(np.int64).ravel(), ends * bands, pa.int64()), _lists(sig.view(np.int32).ravel(), ends * k, pa.int32())],
                    ["row", "doc_id", "t1", "t2", "n", "bands", "signature"],
                )
                number += hi - lo

    return docs.mapInArrow(run, "row long, doc_id long, t1 long, t2 long, n long, bands array<long>, signature array<int>")


BITS = 1 << 23


def marked(keys: DataFrame) -> np.ndarray:
    """A bit array of ``BITS`` bits (1 MB whatever the corpus) with those of the text keys set."""
    got = keys.select(F.pmod("t1", F.lit(BITS)).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return out


def is_marked(bits: np.ndarray, t1: np.ndarray) -> np.ndarray:
    p = np.mod(t1, BITS)
    return (bits[p >> 6] >> (p & 63)) & 1 == 1


def shingles_of(docs: DataFrame, wanted: DataFrame, width: int, weighted: bool) -> DataFrame:
    """row, shingles (sorted; repeated for their counts if ``weighted``) of the texts in
    ``wanted`` (row, t1, t2). A bit array leaves most others out before they are cut."""
    bits = docs.sparkSession.sparkContext.broadcast(marked(wanted))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(1)):
                key = text_keys(buf, off)
                use = np.flatnonzero(is_marked(bits.value, key[:, 0]))
                use = use[np.unique(key[use], axis=0, return_index=True)[1]]
                if not len(use):
                    continue
                buf = np.concatenate([buf[off[i] : off[i + 1]] for i in use])
                off = np.append(0, np.cumsum(off[use + 1] - off[use]))
                s, c, bounds = shingle_sets(buf, off, width)
                if weighted:
                    bounds = np.append(0, np.cumsum(c))[bounds]
                    s = np.repeat(s, c)
                yield pa.RecordBatch.from_arrays([pa.array(key[use, 0]), pa.array(key[use, 1]), _lists(s.view(np.int64), bounds, pa.int64())], ["t1", "t2", "shingles"])

    return docs.mapInArrow(run, "t1 long, t2 long, shingles array<long>").join(wanted, ["t1", "t2"]).dropDuplicates(["row"]).select("row", "shingles")


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of a list and how often each occurs."""
    return np.unique(x, return_counts=True)


def jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two of ``numbered``'s results: least over largest counts."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]):
        return 0.0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    both = int(np.where(y[0][at] == x[0], np.minimum(y[1][at], x[1]), 0).sum())
    return both / (int(x[1].sum()) + int(y[1].sum()) - both)


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarities of two columns of hash lists, row by row (of multisets, if hashes repeat)."""
    ao, av, bo, bv = a.offsets.to_numpy(), a.values.to_numpy(), b.offsets.to_numpy(), b.values.to_numpy()
    return np.array([jaccard(numbered(av[ao[i] : ao[i + 1]]), numbered(bv[bo[i] : bo[i + 1]])) for i in range(len(ao) - 1)])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of at least the similarity ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                keep = similarity(some.column(2), some.column(3)) >= least
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8, bands: int = 20, rows: int = 6, width: int = 5, weighted: bool = True, block: int = 512) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept, for each row of ``docs``.

    One row of each class is kept: that of the smallest doc_id, the first of several."""
    spark = docs.sparkSession
    tune(spark, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stash(sketch(docs, bands, rows, width, weighted))
    texts = stash(sketched.groupBy("t1", "t2").agg(F.min("row").alias("rep"), F.count("*").alias("copies")))
    reps = texts.select(F.col("rep").alias("row"))
    members = sketched.where("n > 0").select("row", F.posexplode("bands").alias("band", "key")).join(reps, "row", "left_semi")
    shared = members.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("row").alias("least"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("mark")).where("size > 1")
    # bands with the same members are one group
    shared = stash(shared.groupBy("size", "least", "mark").agg(F.min(F.struct("band", "key")).alias("g")).select(F.col("g.band").alias("band"), F.col("g.key").alias("key"), "least"))
    buckets = stash(members.join(shared, ["band", "key"]).select("band", "key", "row", "least"))
    ids = buckets.select("row").distinct()
    sets = stash(shingles_of(docs, stash(sketched.select("row", "t1", "t2").join(ids, "row", "left_semi")), width, weighted))
    stars = buckets.where("row <> least").select(F.col("row").alias("a"), F.col("least").alias("b")).distinct()
    links = stash(verified(stars, sets, least))
    first = stash(components(links))
    # bands that still span several components
    placed = buckets.join(first, F.col("row") == F.col("node"), "left").select("band", "key", "row", F.coalesce("component", "row").alias("component"))
    open_ = stash(placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "key"))
    rest = stash(placed.join(open_, ["band", "key"], "left_semi"))
    marks = sketched.select("row", "signature").join(rest.select("row").distinct(), "row", "left_semi")
    tasks = deal(rest, ["band", "key"], "row", block).join(marks.join(sets, "row"), "row")
    tasks = spread(tasks, ["band", "key"]).select("band", "key", "block_i", "block_j", "side", "row", "component", "signature", "shingles")
    k = bands * rows

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, 4):
            ids_, comp = t.column("row").to_numpy(), t.column("component").to_numpy()
            band, side, bi, bj = (t.column(c).to_numpy() for c in ("band", "side", "block_i", "block_j"))
            sig = t.column("signature").combine_chunks().flatten().to_numpy().reshape(-1, k)
            sets_ = t.column("shingles").combine_chunks()
            so, sv = sets_.offsets.to_numpy(), sets_.values.to_numpy()
            size = np.diff(so)
            found = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                now = comp[a:b].copy()  # components as this task joins them
                mine = [numbered(sv[so[i] : so[i + 1]]) for i in range(a, b)]
                n = size[a:b]
                for i in range(b - a):
                    # sets of too different sizes cannot be alike
                    other = (now != now[i]) & (np.arange(b - a) > i) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i]) - 1e-9)
                    if bi[a] != bj[a]:
                        other &= side[a:b] != side[a + i]
                    j = np.flatnonzero(other)
                    if not len(j):
                        continue
                    equal = sig[a + j] == sig[a + i]
                    # a pair belongs to the first of its bands; the likeliest partners come first
                    own = equal.reshape(len(j), bands, rows).all(axis=2).argmax(axis=1) == band[a]
                    j = j[own][np.argsort(-equal[own].sum(axis=1), kind="stable")]
                    for c in j:
                        if now[c] != now[i] and jaccard(mine[i], mine[c]) >= least:
                            found.append((ids_[a + i], ids_[a + c]))
                            now[now == now[c]] = now[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.array(found).T.copy()], ["a", "b"])

    late = stash(tasks.mapInArrow(compare, "a long, b long"))
    joined = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    classes = joined if late.isEmpty() else components(joined.unionByName(late)).select(F.col("node").alias("a"), F.col("component").alias("b"))
    placed = stash(texts.join(classes, F.col("rep") == F.col("a"), "left").select("t1", "t2", F.coalesce("b", "rep").alias("root")))
    known = stash(sketched.select("row", "doc_id", "t1", "t2").join(placed, ["t1", "t2"]).select("row", "doc_id", "root"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head")
    heads = stash(known.groupBy("root").agg(head).select("root", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("first")))
    return known.join(heads, "root").select("doc_id", "class_id", (F.col("row") == F.col("first")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, **how) -> DataFrame:
    """``docs`` with one row of each class of near-duplicate texts, all columns kept. Rows count
    by their texts alone: those of one doc_id or of a null one are separate documents. Of a
    class the row of the smallest doc_id stays, a null one last."""
    row = fresh_name(docs, "row")
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), least, **how).select(F.col("doc_id").alias("n"), "class_id")
    ids = rows.select(F.col(row).alias("n"), F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    kept = classes.join(ids, "n").groupBy("class_id").agg(first).select(F.col("first.n").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
