"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table gives every document the probabilities of being
good and of being toxic, in steps of 1/255, and so posteriors of four domains, the pairs of
(quality, toxic). Document rates r >= 0 are then fitted by projected gradient least squares
so that the expected token totals of the domains, the sums of r * tokens * posterior, match
the targets. A document's gradient depends on its posteriors alone, and there are 256 * 256
of these at most: the cluster sums the tokens of each, over all documents, and the steps are
taken on these sums until they settle; else ``FitError`` is raised. The gradient is taken in
the metric of the domains' own second moments, with a small pull towards rate 1.

A document is sampled by its rate: it is worth floor(rate) copies and, with the probability
of the rest, one more, drawn from a hash of its id and text. Targets that the posteriors
cannot reach exactly are approached in least squares: ``fit_rates`` returns each domain's
target and fitted total, ``domain_totals`` the sampled one as well.

Quality enters by the document statistics; toxicity by hashed words that labelled documents
show to be far more frequent under the label. The fit takes at most ``sample`` labelled ids
(smallest hashes of doc_id), of an id that several rows have the one with the least
features; posteriors, totals and rates cover all documents and whole texts.

Null and empty texts have no tokens: they get the rate of their posteriors and do not count.
With labels of one class alone a label's posterior is its share; without any, documents are
good and not toxic, as nothing is known against them.
Repeated rows get equal rates and copies; other columns pass through, and columns of the
result that would clash get an underscore before their names; an empty table gives an empty
one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.common import fresh_name, stash, table, tune
from verisieve.llm.decontam import APART
from verisieve.llm.features import NAMES, describe
from verisieve.llm.textvec import pieces, words

DOMAINS = ("good_clean", "good_toxic", "poor_clean", "poor_toxic")
#: Targets as multiples of the corpus's expected totals: toxic domains go.
KEEP = (1.0, 0.0, 1.0, 0.0)
SPACE = 1 << 20
#: Probabilities are whole numbers of 1/LEVELS.
LEVELS = 255


class FitError(RuntimeError):
    """The rates did not settle."""


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Logistic weights; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) ** 0.5 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * len(y) ** 0.5 * w)
    return w


@dataclass
class DomainModel:
    mean: np.ndarray
    scale: np.ndarray
    quality: np.ndarray
    marked: np.ndarray
    strength: np.ndarray
    toxic: np.ndarray

    def levels(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(levels of good, levels of toxic, words) of each document."""
        z = np.clip((describe(buf, off) - self.mean) / self.scale, -6, 6)
        good = 1 / (1 + np.exp(-np.clip(np.column_stack([z, np.ones(len(z))]) @ self.quality, -30, 30)))
        t, n = marks_of(buf, off, self.marked, self.strength)
        bad = 1 / (1 + np.exp(-np.clip(t @ self.toxic, -30, 30)))
        return np.rint(good * LEVELS).astype(np.int32), np.rint(bad * LEVELS).astype(np.int32), n


def posteriors(good, bad) -> list:
    """Domain posteriors of levels: of arrays or of columns."""
    g, b = good / float(LEVELS), bad / float(LEVELS)
    return [g * (1 - b), g * b, (1 - g) * (1 - b), (1 - g) * b]


def evidence(times: np.ndarray, strength: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The toxicity model's inputs, from the marked words' occurrences, the summed strength of the
    distinct ones, and the number of words: a long document meets a marked word by chance."""
    some = times > 0
    share = np.log1p(100 * times / np.maximum(n, 1))
    return np.column_stack([np.minimum(strength, 30) / 5, some, np.log1p(times), share, (np.log1p(n) - 5) * some, np.ones(len(n))]).astype(float)


def marks_of(buf: np.ndarray, off: np.ndarray, marked: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``evidence`` of each document, its words)."""
    _, _, h, to = words(buf, off, apart=APART)
    places = (h >> np.uint64(44)).astype(np.int64)
    at = np.minimum(np.searchsorted(marked, places), max(0, len(marked) - 1))
    hits = np.flatnonzero(marked[at] == places) if len(marked) else np.zeros(0, np.int64)
    rows = len(off) - 1
    owner = np.repeat(np.arange(rows), np.diff(to))[hits]
    times = np.bincount(owner, minlength=rows)
    one = np.unique(owner * max(1, len(marked)) + at[hits]) if len(hits) else np.zeros(0, np.int64)
    sums = np.bincount(one // max(1, len(marked)), strength[one % max(1, len(marked))] if len(one) else None, rows)
    _, _, _, plain = words(buf, off)
    return evidence(times, sums, np.diff(to)), np.diff(plain)


def fit_domains(docs: DataFrame, labels: DataFrame, sample: int = 10_000, sure: float = 5.0) -> DomainModel:
    tune(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: `sample` rows of three numbers
    base = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "toxic", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(2)):
                _, _, h, to = words(buf, off, apart=APART)
                sets = [np.unique((h[a:b] >> np.uint64(44)).astype(np.int32)) for a, b in zip(to[:-1], to[1:], strict=True)]
                counted = [np.bincount(np.searchsorted(s, (h[a:b] >> np.uint64(44)).astype(np.int32)), minlength=len(s)).astype(np.int32) for s, a, b in zip(sets, to[:-1], to[1:], strict=True)]
                cols = [batch.column(k).slice(lo, hi - lo) for k in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(list(describe(buf, off)), pa.list_(pa.float64())), pa.array(sets, pa.list_(pa.int32())), pa.array(counted, pa.list_(pa.int32()))], ["quality", "toxic", "doc_id", "x", "w", "c"])

    each = base.mapInArrow(run, "quality int, toxic int, doc_id long, x array<double>, w array<int>, c array<int>")
    # one row for each id, so at most `sample`
    held = stash(each.groupBy("doc_id").agg(F.min(F.struct("x", "w", "c", "quality", "toxic")).alias("r")).select("r.quality", "r.toxic", "r.x", "r.w", "r.c"))
    marked, strength = telling_words(held, sure)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, c = batch.column(3), batch.column(4)
            places, rows = w.flatten().to_numpy(), len(w)
            owner = np.repeat(np.arange(rows), np.diff(w.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(marked, places), max(0, len(marked) - 1))
            hit = np.flatnonzero(marked[at] == places) if len(marked) else np.zeros(0, np.int64)
            counts = c.flatten().to_numpy()
            times = np.bincount(owner[hit], counts[hit], rows).astype(np.int64)
            sums = np.bincount(owner[hit], strength[at[hit]] if len(hit) else None, rows).astype(float)
            n = np.bincount(owner, counts, rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(times), pa.array(sums), pa.array(n)], ["quality", "toxic", "x", "times", "strength", "n"])

    got = held.mapInArrow(seen, "quality int, toxic int, x array<double>, times long, strength double, n long").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(NAMES))
    quality, toxic = (np.array([-1 if v is None else v for v in got.column(c).to_pylist()], int) for c in ("quality", "toxic"))
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])

    def fitted(m: np.ndarray, y: np.ndarray, unknown: float) -> np.ndarray:
        use = (y == 0) | (y == 1)
        if len(set(y[use])) < 2:
            w = np.zeros(m.shape[1])
            w[-1] = unknown if not use.any() else np.log((y[use].sum() + 0.5) / ((1 - y[use]).sum() + 0.5))
            return w
        return newton(m[use], y[use])

    t = evidence(*(got.column(c).to_numpy() for c in ("times", "strength", "n")))
    return DomainModel(mean, scale, fitted(z, quality, 30.0), marked, strength, fitted(t, toxic, -30.0))


def telling_words(held: DataFrame, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the words far more frequent in documents marked toxic, and the logarithms
    of how many times more.

    ``held`` has one row a labelled document (toxic, w: its distinct places), a bounded
    sample. One task streams it into two counters of ``SPACE`` places, so nothing is
    shuffled and only the places found come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, SPACE), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            toxic = batch.column(0).fill_null(-1).to_numpy()
            vals, owner = batch.column(1).flatten().to_numpy(), np.repeat(toxic, np.diff(batch.column(1).offsets.to_numpy()))
            for k in (0, 1):
                seen[k] += np.bincount(vals[owner == k], minlength=SPACE)
                rows[k] += (toxic == k).sum()
        if rows.all():
            (nb, na), (b, a) = rows, seen
            p = (a + b) / (na + nb)
            far = (a / na - b / nb) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / na + 1 / nb))
            at = np.flatnonzero((far >= sure) & (a / na >= 4 * b / nb) & (a >= 3))
            more = np.log((a[at] + 0.5) / (na + 1)) - np.log((b[at] + 0.5) / (nb + 1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(more)], ["w", "more"])

    found = held.select("toxic", "w").coalesce(1).mapInArrow(run, "w int, more double").toArrow()
    places = found.column("w").to_numpy().astype(np.int64)
    order = np.argsort(places)
    return places[order], found.column("more").to_numpy()[order]


def with_levels(docs: DataFrame, model: DomainModel, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with words, level of good and level of toxic in the columns ``names``."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.select("*", *[F.lit(0).cast(k).alias(c) for c, k in zip(names, ("long", "int", "int"), strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.levels(buf, off) for _, _, buf, off in pieces(batch.column(at))]
            good, bad, n = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (list(zip(*got, strict=True)) or [[]] * 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array(good), pa.array(bad)], schema.names)

    return docs.mapInArrow(run, schema)


def cells_of(facts: DataFrame, n: str, good: str, bad: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, posteriors) of each pair of levels, over all rows; 65,536 at most."""
    got = facts.groupBy(good, bad).agg(F.sum(n).alias("n")).orderBy(good, bad).toPandas()
    p = np.array(posteriors(got[good].to_numpy(float), got[bad].to_numpy(float))).T.reshape(len(got), len(DOMAINS))
    return got["n"].fillna(0).to_numpy(float), p


def fit_rates(n: np.ndarray, p: np.ndarray, keep: tuple[float, ...] = KEEP, targets: dict[str, float] | None = None, ridge: float = 0.01, steps: int = 20_000, close: float = 1e-7) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """The rate of each cell (tokens ``n``, posteriors ``p``), and each domain's (target, fitted) token total.

    ``targets`` are token totals by domain; without them they are ``keep`` times the expected
    totals. Accelerated projected gradient steps from the rate 1 on the squared miss of the
    targets plus ``ridge`` times the tokens' squared distance from rate 1, which makes the
    rates unique; done when a step moves them by no more than ``close``."""
    total = n @ p
    target = np.array([targets[d] for d in DOMAINS], float) if targets else np.array(keep) * total
    scale = max(total.sum(), 1.0)
    metric = np.linalg.inv((n[:, None] * p).T @ p / scale + 1e-4 * np.eye(len(DOMAINS)))
    rate = ahead = np.ones(len(n))
    pace = 1.0
    for _ in range(steps):
        downhill = p @ (metric @ (((n * ahead) @ p - target) / scale)) + ridge * (ahead - 1)
        then = np.maximum(0.0, ahead - downhill / (1 + ridge))
        if (n * (ahead - then)) @ (then - rate) > 0:  # overshot: start the acceleration anew
            pace = 1.0
        moved = float((n / scale) @ (then - rate) ** 2) ** 0.5
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, rate, pace = then + (pace - 1) / after * (then - rate), then, after
        if moved <= close:
            break
    else:
        raise FitError(f"rates still move by {moved:g} after {steps} steps")
    return rate, {d: (float(t), float(f)) for d, t, f in zip(DOMAINS, target, (n * rate) @ p, strict=True)}


@dataclass
class Mixture:
    """``rows``: the documents with columns for the words, levels, rate and copies, under ``names``;
    ``totals``: (target, fitted) tokens by domain."""

    rows: DataFrame
    names: dict[str, str]
    totals: dict[str, tuple[float, float]]


def fit_mixture(docs: DataFrame, labels: DataFrame, keep: tuple[float, ...] = KEEP, targets: dict[str, float] | None = None) -> Mixture:
    """Every row of ``docs`` with its rate and the copies that it is worth (0 or more)."""
    names = {c: fresh_name(docs, c) for c in ("n_tokens", "good", "toxic", "rate", "copies")}
    n, good, toxic = (names[c] for c in ("n_tokens", "good", "toxic"))
    held = stash(with_levels(docs, fit_domains(docs, labels), (n, good, toxic)))
    tokens, p = cells_of(held, n, good, toxic)
    rate, totals = fit_rates(tokens, p, keep, targets)
    spark = docs.sparkSession
    level = lambda x: pa.array(np.rint(x * LEVELS).astype(np.int32))
    table_ = pa.table({good: level(p[:, 0] + p[:, 1]), toxic: level(p[:, 1] + p[:, 3]), names["rate"]: pa.array(rate)})
    cells = spark.createDataFrame(table_)  # 65,536 rows at most
    r = F.col(names["rate"])
    drawn = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id"), F.col("text")), F.lit(1 << 24)) / float(1 << 24)
    rows = held.join(F.broadcast(cells), [good, toxic]).withColumn(names["copies"], (F.floor(r) + (drawn < r - F.floor(r)).cast("int")).cast("int"))
    return Mixture(rows, names, totals)


def domain_totals(mix: Mixture) -> DataFrame:
    """domain, target, fitted, sampled: token totals; the last is what the copies come to."""
    c = mix.names
    p = posteriors(F.col(c["good"]), F.col(c["toxic"]))
    got = mix.rows.agg(*[F.coalesce(F.sum(F.col(c["n_tokens"]) * F.col(c["copies"]) * x), F.lit(0.0)).alias(d) for d, x in zip(DOMAINS, p, strict=True)]).first()
    return mix.rows.sparkSession.createDataFrame([(d, *mix.totals[d], float(got[d])) for d in DOMAINS], "domain string, target double, fitted double, sampled double")


def mix_documents(docs: DataFrame, labels: DataFrame, keep: tuple[float, ...] = KEEP, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, the posterior of each domain, rate, copies for every row of ``docs``."""
    mix = fit_mixture(docs.select("doc_id", "text"), labels, keep, targets)
    p = posteriors(F.col("good"), F.col("toxic"))
    return mix.rows.select("doc_id", "n_tokens", *[x.alias(d) for d, x in zip(DOMAINS, p, strict=True)], "rate", "copies")


def sample_mixture(docs: DataFrame, labels: DataFrame, keep: tuple[float, ...] = KEEP, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` that are worth a copy, with all columns and with their rate and copies."""
    mix = fit_mixture(docs, labels, keep, targets)
    return mix.rows.where(F.col(mix.names["copies"]) > 0).select(*docs.columns, mix.names["rate"], mix.names["copies"])


def op10_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
