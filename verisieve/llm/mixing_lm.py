"""Language-model scores by online logistic context mixing.

A document is its words (bytes outside white space, A-Z lower-cased) and one end token.
A token's 64-bit hash begins with ``DEPTH`` bits that are predicted one after another;
which word it is among those of its leading bits follows from the counts of all training
words there, with the same 0.5 for a word and for the unknown as the base model has.

A bit is predicted from counts in hashed contexts (none, the word before, the two words
before, the ending of the word before, the last very frequent word) and by a match model
(what followed the last occurrence of the word before in this document). The stretched
predictions are mixed by weights that a gate selects (bit depth, match or none); the
weights are learned online by logistic loss, with the coded bit itself left out of its
counts. An adaptive map of (gate, mixed prediction) refines the result. Total bits over
bytes is in bits_per_byte.

A memory of the corpus stands beside the mixer. A document is cut into passages after every
word pair whose hash says so (about every eighth), so equal texts are cut alike wherever they
stand. All passages of ``LEAST`` tokens or more are counted by a hash of the whole passage.
Before a passage one bit is coded, whether it comes from memory: if so its probability is its
share of the remembered passages, otherwise the mixer spells it. A known passage takes the
likelier way (spelling only where each of its words is in ``top``). A training document is
scored by what the others left: its own passages are taken out of the memory's counts.

Counts, weights and maps come from all training documents (crc32(doc_id) mod 5 is not 1).
Tasks count leaves, the leading bits under each context; the counts of the bits before
follow from these. The context tables and the ``TOP`` most frequent words and passages have
fixed sizes and go to every task; all others are looked up by joins with the counts, which
grow with the corpus.

Null text is empty: only the end token. A null id is not held out. Rows of one doc_id are
separate documents. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.common import stash, table, tune
from verisieve.llm.quality import crc_rest
from verisieve.llm.textvec import BASE, LOWER, mix, pieces, words

U = np.uint64
DEPTH, TOP, FREQUENT = 10, 1 << 17, 255
#: Bits of each context's number: none, the word before, the two words before, the ending of
#: the word before, the last very frequent word.
WIDTHS = (0, 12, 12, 8, 8)
CONTEXTS = len(WIDTHS)
#: Where each context's nodes begin; every number has 2**DEPTH of them.
STARTS = np.cumsum([0, *(1 << w + DEPTH for w in WIDTHS)])
INPUTS = CONTEXTS + 2  # and the match model and a constant
STEPS = 33
#: Stretched predictions are whole numbers of 1/FINE.
FINE = 1024
SLAB = 1 << 16
#: Passages of fewer tokens are not remembered.
LEAST = 4
END = mix(np.array([0x1F2E3D4C5B6A7988], U))[0]


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ending codes, bounds): each row's words and its end token."""
    start, end, h, to = words(buf, off)
    n = len(off) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(to))
    bounds = to + np.arange(n + 1)
    out = np.empty(len(h) + n, U)
    out[at] = h
    out[bounds[1:] - 1] = END
    tail = np.zeros(len(out), np.uint32)
    if len(h):
        tail[at] = LOWER[buf[end - 1]].astype(np.uint32) * 31 + LOWER[buf[np.maximum(end - 2, start)]]
    return out, tail, bounds


def passages(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the passages that the tokens are cut into."""
    before = np.zeros(len(h), U)
    before[1:] = h[:-1]
    before[bounds[:-1]] = 0
    last = mix(h + mix(before)) >> U(61) == 0
    last[bounds[1:] - 1] = True
    end = np.flatnonzero(last) + 1
    start = np.append(0, end[:-1])
    place = np.arange(len(h)) - np.repeat(start, end - start)
    # sums of mixed values, not a polynomial: long regular texts have none in common
    return start, end, mix(np.add.reduceat(mix(h + place.astype(U) * U(BASE)), start) + (end - start).astype(U))


def _folded(x: np.ndarray, bits: int) -> np.ndarray:
    return (mix(x) >> U(64 - bits)).astype(np.int64)


def contexts(h: np.ndarray, tail: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token: where its contexts' nodes begin in the table (CONTEXTS x tokens), and
    the leading bits of the token that the match model expects (-1: none)."""
    n = len(h)
    first = np.zeros(n, bool)
    first[bounds[:-1]] = True
    before = np.empty(n, U)
    before[1:] = h[:-1]
    ending = np.zeros(n, np.uint32)
    ending[1:] = tail[:-1]
    before[first] = 0
    ending[first] = 0
    # the last of the most frequent words before this token
    place = np.minimum(np.searchsorted(frequent, before), max(0, len(frequent) - 1))
    known = (frequent[place] == before) & ~first if len(frequent) else np.zeros(n, bool)
    mark = np.where(known, np.arange(n), np.where(first, np.arange(n), 0))
    last = np.maximum.accumulate(mark)
    topic = np.where(known[last], place[last] + 1, 0)
    two = np.zeros(n, U)
    two[1:] = before[:-1]
    two[first] = 0
    number = (np.zeros(n, np.int64), _folded(before, 12), _folded(mix(before) + two, 12), (ending * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64), topic.astype(np.int64))
    base = np.array([start + (x << DEPTH) for start, x in zip(STARTS, number)])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = before ^ mix(owner.astype(U) + U(1))
    order = np.argsort(key, kind="stable")
    expect = np.full(n, -1, np.int64)
    same = key[order][1:] == key[order][:-1]
    expect[order[1:][same]] = (h[order[:-1][same]] >> U(64 - DEPTH)).astype(np.int64)
    expect[first] = -1
    return base, expect


def _rows(kind: int, index: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(index), kind, np.int32)), pa.array(index.astype(np.int64)), pa.array(a.astype(np.float64)), pa.array(b.astype(np.float64))], ["kind", "i", "a", "b"])


SUMS = "kind int, i long, a double, b double"


def _summed(df: DataFrame) -> list[np.ndarray]:
    got = df.groupBy("kind", "i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    kind, i, a, b = (got.column(c).to_numpy() for c in ("kind", "i", "a", "b"))
    return [(i[kind == k], a[kind == k], b[kind == k]) for k in (0, 1)]


def corpus_counts(train: DataFrame) -> DataFrame:
    """passage, h, c: every training token (passage is false) and remembered passage (true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[tuple[np.ndarray, np.ndarray]], ...] = ([], [])

        def put(kind: int) -> pa.RecordBatch:
            h, c = np.concatenate([x for x, _ in held[kind]]), np.concatenate([x for _, x in held[kind]])
            order = np.argsort(h)
            h, c = h[order], c[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            held[kind].clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind == 1)), pa.array(h[at].view(np.int64)), pa.array(np.add.reduceat(c, at))], ["passage", "h", "c"])

        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                h, _, bounds = tokens(buf, off)
                if len(h):
                    start, end, g = passages(h, bounds)
                    for kind, some in enumerate((h, g[end - start >= LEAST])):
                        held[kind].append(np.unique(some, return_counts=True))
                for kind in (0, 1):
                    if sum(len(x) for x, _ in held[kind]) > 1_000_000:
                        yield put(kind)
        for kind in (0, 1):
            if sum(len(x) for x, _ in held[kind]):
                yield put(kind)

    return train.select("text").mapInArrow(run, "passage boolean, h long, c long").groupBy("passage", "h").agg(F.sum("c").alias("c"))


def context_counts(train: DataFrame, frequent: np.ndarray, fan: int = 256) -> np.ndarray:
    """How often each leaf (leading bits under a context's number) occurs, over all training tokens.

    Tasks send packed slabs of the leaves that they met; slabs are summed over ``fan`` tasks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STARTS[-1], np.uint32)
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                h, tail, bounds = tokens(buf, off)
                if len(h):
                    base, _ = contexts(h, tail, bounds, frequent)
                    np.add.at(total, (base | (h >> U(64 - DEPTH)).astype(np.int64)).ravel(), 1)
        for k in range(0, len(total), SLAB):
            part = total[k : k + SLAB]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([TaskContext.get().partitionId()]), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["at", "task", "part"])

    def add(t: pa.Table) -> pa.Table:
        whole = np.zeros(SLAB, np.uint64)
        for b in t.column("part"):
            part = np.frombuffer(zlib.decompress(b.as_py()), np.uint32)
            whole[: len(part)] += part
        part = np.minimum(whole, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"at": t.column("at").slice(0, 1), "task": t.column("task").slice(0, 1), "part": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    kinds = "at long, task int, part binary"
    tasks = train.rdd.getNumPartitions()
    slabs = train.select("text").mapInArrow(run, "at long, task long, part binary").withColumn("task", F.col("task").cast("int"))
    while True:
        tasks = -(-tasks // fan)
        slabs = slabs.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("at", "task").applyInArrow(add, kinds)
        if tasks <= 1:
            break
    out = np.zeros(-(-STARTS[-1] // SLAB) * SLAB, np.uint32)
    for r in slabs.select("at", "part").toLocalIterator():
        out[r.at : r.at + SLAB] = np.frombuffer(zlib.decompress(r.part), np.uint32)
    return out[: STARTS[-1]]


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


def stretched(leaves: np.ndarray) -> np.ndarray:
    """From counts of leaves, for each node (1, then the leading bits so far) three columns of
    stretched predictions in 1/FINE: after all counts, and with one 0 or one 1 less."""
    out = np.zeros((len(leaves), 3), np.int16)
    below = leaves.reshape(-1, 1 << DEPTH).astype(np.float32)
    nodes = out.reshape(-1, 1 << DEPTH, 3)
    for d in reversed(range(DEPTH)):
        n0, n1 = below[:, 0::2], below[:, 1::2]
        for k, (a, b) in enumerate(((0, 0), (1, 0), (0, 1))):
            nodes[:, 1 << d : 2 << d, k] = np.rint(FINE * stretch(np.maximum(n0 - a, 0), np.maximum(n1 - b, 0)))
        below = n0 + n1
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def match_input(expect: np.ndarray, lead: np.ndarray, d: int) -> np.ndarray:
    """+1 or -1 where the expected token agrees with the bits so far, else 0."""
    alive = (expect >= 0) & ((expect >> (DEPTH - d)) == (lead >> (DEPTH - d)))
    return np.where(alive, (expect >> (DEPTH - 1 - d) & 1) * 2 - 1, 0).astype(np.float32)


def steps_of(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 2 + STEPS // 2), 0, STEPS - 1).astype(np.int64)


def learn_mixer(train: DataFrame, frequent: np.ndarray, tables: np.ndarray, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DEPTH x 2 x INPUTS) and the adaptive map's counts (DEPTH x 2 x STEPS x 2).

    Every token of every training document takes part. Each partition learns online; weights are averaged by the number of bits."""
    sent = train.sparkSession.sparkContext.broadcast(np.ascontiguousarray(tables[:, 1:]))  # 36 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        less = sent.value.reshape(-1)
        w = np.full((DEPTH, 2, INPUTS), 0.3, np.float32)
        w[:, :, -1] = 0
        seen, fine = np.zeros((DEPTH, 2)), np.zeros((DEPTH, 2, STEPS, 2))
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                h, tail, bounds = tokens(buf, off)
                if not len(h):
                    continue
                base, expect = contexts(h, tail, bounds, frequent)
                lead = (h >> U(64 - DEPTH)).astype(np.int64)
                x = np.empty((len(lead), INPUTS), np.float32)
                x[:, -1] = 1
                for d in range(DEPTH):
                    node, bit = (1 << d) | (lead >> (DEPTH - d)), lead >> (DEPTH - 1 - d) & 1
                    for k in range(CONTEXTS):
                        x[:, k] = less[(base[k] | node) * 2 + bit]
                    x[:, :CONTEXTS] *= 1 / FINE
                    x[:, CONTEXTS] = match_input(expect, lead, d)
                    matched = x[:, CONTEXTS] != 0
                    for m, part in enumerate((np.flatnonzero(~matched), np.flatnonzero(matched))):
                        given, said = x[part], bit[part]
                        for a in range(0, len(part), 2048):
                            some, y = given[a : a + 2048], said[a : a + 2048]
                            z = some @ w[d, m]
                            w[d, m] += rate * ((y - squash(z)) @ some) / len(y) * min(8, len(y) / 64)
                            fine[d, m] += np.bincount(steps_of(z) * 2 + y, minlength=2 * STEPS).reshape(STEPS, 2)
                        seen[d, m] += len(part)
        yield _rows(0, np.arange(w.size), (w * seen[:, :, None]).ravel(), np.repeat(seen.ravel(), INPUTS))
        yield _rows(1, np.arange(fine.size // 2), fine.reshape(-1, 2)[:, 0], fine.reshape(-1, 2)[:, 1])

    (i, a, b), (j, f0, f1) = _summed(train.select("text").mapInArrow(run, SUMS))
    w = np.full(DEPTH * 2 * INPUTS, 0.3)
    w[i] = np.where(b > 0, a / np.maximum(b, 1), 0.3)
    fine = np.zeros((DEPTH * 2 * STEPS, 2))
    fine[j, 0], fine[j, 1] = f0, f1
    return w.reshape(DEPTH, 2, INPUTS).astype(np.float32), fine.reshape(DEPTH, 2, STEPS, 2)


def refined(fine: np.ndarray) -> np.ndarray:
    """The adaptive map's probabilities; few counts stay near the mixed prediction."""
    middle = squash((np.arange(STEPS) - STEPS // 2) / 2.0)
    return (fine[..., 1] + 20 * middle) / (fine.sum(-1) + 20)


@dataclass
class MixModel:
    """What the tasks score with; ``counts`` and ``memory`` (h, c) are the tables of all words and passages. The rest is of fixed size."""

    counts: DataFrame
    memory: DataFrame
    tokens: int
    words: int
    frequent: np.ndarray
    table: np.ndarray
    weights: np.ndarray
    map: np.ndarray
    top: tuple[np.ndarray, np.ndarray]
    per_lead: np.ndarray
    top_passages: tuple[np.ndarray, np.ndarray]
    passages: int
    from_memory: float


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    top = counts.orderBy(F.desc("c"), "h").limit(TOP).toArrow()
    return top.column("h").to_numpy().view(U), top.column("c").to_numpy()


def fit_mixer(train: DataFrame) -> MixModel:
    """Learn from all rows of ``train`` (text)."""
    both = stash(corpus_counts(train))
    counts, memory = (both.where(which).select("h", "c") for which in ("not passage", "passage"))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    met = memory.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("again")).first()
    top_h, top_c = _most_frequent(counts)
    top_g, top_gc = _most_frequent(memory)
    frequent = np.sort(top_h[:FREQUENT])
    order, order_g = np.argsort(top_h), np.argsort(top_g)
    leads = np.zeros((1 << DEPTH, 2))
    lead_of = F.shiftrightunsigned("h", 64 - DEPTH).cast("int")
    for r in counts.groupBy(lead_of.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        leads[r.b] = r.c, r.v
    tables = stretched(context_counts(train, frequent))
    weights, fine = learn_mixer(train, frequent, tables)
    return MixModel(
        counts, memory, int(whole.n), int(whole.v), frequent, np.ascontiguousarray(tables[:, 0]), weights, refined(fine).astype(np.float32), (top_h[order], top_c[order].astype(np.float64)),
        np.log10(leads[:, 0] + 0.5 * (leads[:, 1] + 1)), (top_g[order_g], top_gc[order_g]), int(met.n), (met.again + 1) / (met.n + 100),
    )


def score_corpus(docs: DataFrame) -> DataFrame:
    """The scores of all rows of ``docs`` (doc_id, text); learns from those that are not held out."""
    tune(docs.sparkSession, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(crc_rest("doc_id") == 1, F.lit(False)).alias("held_out"))
    return score_documents(docs, fit_mixer(docs.where("not held_out")))


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted ``keys``, and their values (0: not there)."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), values.dtype)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[place] == wanted
    return there, np.where(there, values[place], 0)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
    return np.flatnonzero(new)


#: What becomes of a passage: spelled, taken from memory, or looked up in the table.
SPELLED, KNOWN, ASKED = 0, 1, 2
SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_passages long, top long, logs double, coded double, "
    "rare array<long>, times array<long>, spelled array<boolean>, asked array<long>, asked_times array<long>, asked_coded array<double>, asked_rare array<array<long>>"
)


def score_documents(docs: DataFrame, fitted: MixModel) -> DataFrame:
    """The scores of the rows of ``docs`` (doc_id, text, held_out)."""
    n, v, whole, share = fitted.tokens, fitted.words, fitted.passages, fitted.from_memory
    spell, recall = float(np.log10(1 - share)), float(np.log10(share))
    model = docs.sparkSession.sparkContext.broadcast((fitted.frequent, fitted.table, fitted.weights, fitted.map, *fitted.top, fitted.per_lead, *fitted.top_passages))  # about 23 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_, tables, w, apm, th, tc, per, gh, gc = model.value
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                h, tail, bounds = tokens(buf, off)
                base, expect = contexts(h, tail, bounds, frequent_)
                lead = (h >> U(64 - DEPTH)).astype(np.int64)
                logs = np.zeros(len(h))
                for d in range(DEPTH):
                    node, bit = (1 << d) | (lead >> (DEPTH - d)), lead >> (DEPTH - 1 - d) & 1
                    x = match_input(expect, lead, d)
                    m = (x != 0).astype(np.int64)
                    z = x * w[d, m, CONTEXTS] + w[d, m, -1]
                    for k in range(CONTEXTS):
                        z += tables[base[k] | node] * (w[d, m, k] * np.float32(1 / FINE))
                    p = (squash(z) + apm[d, m, steps_of(z)]) / 2
                    logs += np.log10(np.where(bit == 1, p, 1 - p))
                is_top, count = _looked_up(th, tc, h)
                known = np.where(is_top, np.log10(count + 0.5), 0)
                rows = hi - lo
                ids, held = np.arange(rows + 1), batch.column(2).slice(lo, rows).to_numpy(zero_copy_only=False).astype(bool)
                owner = np.repeat(ids[:-1], np.diff(bounds))
                # passages: one group for each text in each row
                start, end, g = passages(h, bounds)
                of, length = owner[start], end - start
                coded = np.add.reduceat(logs - per[lead] + known, start)
                strange = np.add.reduceat((~is_top).astype(np.int64), start)
                kept = np.flatnonzero(length >= LEAST)
                n_passages = np.bincount(of[kept], minlength=rows)
                kept = kept[np.lexsort((g[kept], of[kept]))]
                at = _runs(of[kept], g[kept])
                one, times = kept[at], np.diff(np.append(at, len(kept)))
                spelling = np.add.reduceat(coded[kept], at) if len(at) else np.zeros(0)
                found, c = _looked_up(gh, gc, g[one])
                others = c - times * ~held[of[one]]
                state = np.where(found, np.where(others > 0, KNOWN, SPELLED), ASKED)
                left = np.maximum(whole - n_passages * ~held, 1)[of[one]]
                taken = recall + np.log10(np.maximum(others, 1) / left)
                taken = times * np.where(strange[one] == 0, np.maximum(taken, spelling / np.maximum(times, 1) + spell), taken)
                score = np.bincount(of, np.where(length < LEAST, coded + spell, 0), rows)
                score += np.bincount(of[one], np.choose(state, (spelling + times * spell, taken, 0.0)), rows)
                # rare words of the passages that are settled, and of those to be looked up
                what = np.zeros(len(start), np.int64)
                what[kept] = np.repeat(state, times)
                of_token = np.repeat(what, length)
                rare = np.flatnonzero(~is_top & (of_token != ASKED))
                rare = rare[np.lexsort((h[rare], of_token[rare], owner[rare]))]
                first = _runs(owner[rare], of_token[rare], h[rare])
                ends = np.searchsorted(owner[rare[first]], ids).astype(np.int32)
                put = lambda x, to: pa.ListArray.from_arrays(pa.array(to), pa.array(x))
                ask = state == ASKED
                some = one[ask]
                spots = np.repeat(start[some], length[some]) + np.arange(length[some].sum()) - np.repeat(np.cumsum(length[some]) - length[some], length[some])
                inner = np.append(0, np.cumsum(strange[some])).astype(np.int32)
                outer = np.searchsorted(of[some], ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.arange(rows) + number) | (task << 40)), batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows),
                        pa.array(np.diff(bounds)), pa.array(np.diff(off)), pa.array(n_passages), pa.array(np.bincount(owner, is_top, rows).astype(np.int64)), pa.array(np.bincount(owner, known, rows)), pa.array(score),
                        put(h[rare[first]].view(np.int64), ends), put(np.diff(np.append(first, len(rare))), ends), put(of_token[rare[first]] == SPELLED, ends),
                        put(g[some].view(np.int64), outer), put(times[ask], outer), put(spelling[ask], outer), pa.ListArray.from_arrays(pa.array(outer), put(h[spots[~is_top[spots]]].view(np.int64), inner)),
                    ],
                    [c.split()[0] for c in SCORED.split(", ")],
                )
                number += rows

    rows = stash(docs.select("doc_id", "text", "held_out").mapInArrow(run, SCORED))
    own = lambda x: F.when(F.col("held_out"), 0).otherwise(x)
    asked = rows.select("row", "held_out", "n_passages", F.explode(F.arrays_zip("asked", "asked_times", "asked_coded", "asked_rare")).alias("r"))
    asked = asked.select("row", "held_out", "n_passages", F.col("r.asked").alias("h"), F.col("r.asked_times").alias("times"), F.col("r.asked_coded").alias("spelling"), F.col("r.asked_rare").alias("rare"))
    asked = asked.join(fitted.memory, "h", "left").withColumn("others", F.coalesce("c", F.lit(0)) - own(F.col("times")))
    taken = recall + F.log10(F.greatest("others", F.lit(1)) / F.greatest(whole - own(F.col("n_passages")), F.lit(1)))
    taken = F.when(F.size("rare") == 0, F.greatest(taken, F.col("spelling") / F.col("times") + spell)).otherwise(taken)
    spelled = F.col("others") <= 0
    asked = stash(asked.select("row", "times", "rare", spelled.alias("spelled"), F.when(spelled, F.col("spelling") + F.col("times") * spell).otherwise(F.col("times") * taken).alias("coded")))
    each = rows.select("row", F.explode(F.arrays_zip("rare", "times", "spelled")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("times"), F.col("r.spelled").alias("spelled"))
    each = each.unionByName(asked.select("row", F.explode("rare").alias("h"), "times", "spelled"))
    rest = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    met = each.join(fitted.counts, "h", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(rest).alias("rest"), F.sum(F.when(F.col("spelled"), rest)).alias("spelt"))
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "n_bytes", "top", "logs", "coded").join(met, "row", "left").join(asked.groupBy("row").agg(F.sum("coded").alias("looked_up")), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.col("coded") + zero("looked_up") + zero("spelt")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("top") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("rest") - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"), score.alias("score"), (-score / float(np.log10(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
