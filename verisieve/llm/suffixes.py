"""Exact repeated passages by a depth-limited radix sort of sampled suffixes.

A passage of ``depth`` bytes that also starts anywhere else is a repeat. Of the
suffixes that start within a passage, the sort takes the one whose first ``digit``
bytes have the least hash (the leftmost of several): equal passages choose the same
one, so sorting these suffixes, one in about (depth - digit) / 2 bytes, decides for all.
Consecutive passages that choose one suffix are a run. The passes go from the most
significant digit on and drop what stands alone:

1. by the first ``digit`` bytes of the suffix: groups of one are not repeated;
2. by the whole span of a run: all passages of equal spans are repeats;
3. runs that are left, with one run for each span of pass 2, by each passage through
   its full depth, within the group of pass 1. A group of over ``most`` runs is sorted
   over the cluster, passage by passage.

The digits of pass 1 are compared as 64-bit hashes, which only deal the runs into groups:
a false match costs work and changes nothing. Whole spans are equal when their SHA-256
is, passages of pass 3 when their bytes are (over the cluster: their SHA-256), and texts
are told apart by SHA-256 (the first 128 bits of each).

Groups are counted by aggregates that combine before the shuffle. Every byte of whole
texts is covered; passages never cross documents.

Null is empty text. Rows of one doc_id are separate documents. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm.blocks import groups
from verisieve.llm.common import stash, table, tune
from verisieve.llm.dartminhash import is_marked, marked
from verisieve.llm.textvec import digests, pieces, prefix_code, span_hash

PLACE = np.uint64((1 << 30) - 1)
KEY = ["t1", "t2"]
RUNS = "t1 long, t2 long, g long, s1 long, s2 long, at int, n int, twice boolean, twice_s boolean"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of values[i:i+width]."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(buf: np.ndarray, off: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """(row, first passage, passages, suffix, code) of each run of the rows' passages."""
    code = prefix_code(buf)
    empty = np.zeros(0, np.int64)
    if len(buf) < depth:
        return empty, empty, empty, empty, code
    at = np.arange(len(buf) - digit + 1)
    h = span_hash(code, at, at + digit)
    key = (h & ~PLACE) | at.astype(np.uint64)
    chosen = (sliding_least(key, depth - digit + 1) & PLACE).astype(np.int64)
    size = np.diff(off)
    row_of = np.repeat(np.arange(len(size)), np.maximum(size - depth + 1, 0))
    first = np.repeat(off[:-1], np.maximum(size - depth + 1, 0))
    ahead = np.cumsum(np.maximum(size - depth + 1, 0))
    start = first + np.arange(len(row_of)) - np.repeat(ahead - np.maximum(size - depth + 1, 0), np.maximum(size - depth + 1, 0))
    pick = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row_of[1:] != row_of[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(start)))
    return row_of[begin], start[begin], count, pick[begin], code


def _twice(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a row has this key more than once."""
    order = np.lexsort((key, row))
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(row), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """t1, t2, text (binary), once for each distinct text in ``keys`` (columns t1, t2). Bits
    leave most of the others out before the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(marked(keys))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                t = digests(buf, off[:-1], off[1:])
                keep = np.flatnonzero(is_marked(bits.value, t[:, 0]))
                keep = keep[np.unique(t[keep], axis=0, return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(t[keep, 0]), pa.array(t[keep, 1]), pa.array([buf[off[i] : off[i + 1]].tobytes() for i in keep], pa.binary())], ["t1", "t2", "text"])

    return docs.select("text").mapInArrow(run, "t1 long, t2 long, text binary").join(keys, KEY, "left_semi").dropDuplicates(KEY)


def windows(spans: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, member, place in its span, place in the bytes) of every passage of the spans."""
    off = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1].astype(np.int64)
    buf = np.frombuffer(spans.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    count = np.diff(off) - depth + 1
    who = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    return buf, who, place, off[who] + place


def equal_passages(buf: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which passages of ``depth`` bytes at ``at`` occur more than once in their group: found by
    hashes, confirmed byte by byte."""
    code = prefix_code(buf)
    h = span_hash(code, at, at + depth)
    order = np.lexsort((h, group))
    hs, gs = h[order], group[order]
    same = np.flatnonzero((hs[1:] == hs[:-1]) & (gs[1:] == gs[:-1]))
    out = np.zeros(len(at), bool)
    reach = np.arange(depth)
    wrong = []
    for lo in range(0, len(same), 20_000):
        part = same[lo : lo + 20_000]
        ok = (buf[at[order[part]][:, None] + reach] == buf[at[order[part + 1]][:, None] + reach]).all(axis=1)
        out[order[part[ok]]] = True
        out[order[part[ok] + 1]] = True
        wrong += part[~ok].tolist()
    # passages of one hash that are not all equal: settled by the bytes themselves
    for i in wrong:
        first, last = np.searchsorted(gs, gs[i]), np.searchsorted(gs, gs[i], "right")
        first, last = first + np.searchsorted(hs[first:last], hs[i]), first + np.searchsorted(hs[first:last], hs[i], "right")
        held: dict[bytes, list[int]] = {}
        for k in order[first:last].tolist():
            held.setdefault(buf[at[k] : at[k] + depth].tobytes(), []).append(k)
        for ks in held.values():
            out[ks] = len(ks) > 1
    return out


def repeated_spans(docs: DataFrame, depth: int = 200, digit: int = 64, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(facts, spans): doc_id, t1, t2, n_bytes, whole (sha256) of each row of ``docs``; and
    t1, t2, a, b: byte ranges of distinct texts that are covered by repeats (they may overlap)."""
    spark = docs.sparkSession
    tune(spark, 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def facts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in pieces(batch.column(1)):
                raw = [hashlib.sha256(buf[off[i] : off[i + 1]]) for i in range(hi - lo)]
                t = np.frombuffer(b"".join(x.digest()[:16] for x in raw), np.int64).reshape(-1, 2)
                whole = [x.hexdigest() for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(t[:, 0]), pa.array(t[:, 1]), pa.array(np.diff(off)), pa.array(whole, pa.string())], ["doc_id", "t1", "t2", "n_bytes", "whole"])

    facts = stash(docs.mapInArrow(facts_of, "doc_id long, t1 long, t2 long, n_bytes long, whole string"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                row, start, count, pick, code = runs_of(buf, off, depth, digit)
                t = digests(buf, off[:-1], off[1:])
                one = np.unique(t, axis=0, return_index=True)[1]
                use = np.isin(row, one)
                row, start, count, pick = row[use], start[use], count[use], pick[use]
                if not len(row):
                    continue
                g = span_hash(code, pick, pick + digit).view(np.int64)
                s = digests(buf, start, start + count - 1 + depth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[row, 0]), pa.array(t[row, 1]), pa.array(g), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array((start - off[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(_twice(row, g)), pa.array(_twice(row, s[:, 0]))],
                    ["t1", "t2", "g", "s1", "s2", "at", "n", "twice", "twice_s"],
                )

    runs = stash(docs.select("text").mapInArrow(first_pass, RUNS))
    # written tables on both sides of a join let a group of many rows be split between tasks
    shared = stash(runs.groupBy("g").agg(((F.min("t1") != F.max("t1")) | F.max("twice")).alias("many")).where("many").select("g"))
    left = stash(runs.join(shared, "g", "left_semi"))
    spans = stash(left.groupBy("g", "s1", "s2").agg(((F.min("t1") != F.max("t1")) | F.max("twice_s")).alias("many"), F.min(F.struct("t1", "t2", "at", "n")).alias("one")))
    equal = left.join(spans.where("many").select("g", "s1", "s2"), ["g", "s1", "s2"], "left_semi")
    found = equal.select(*KEY, F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + depth).alias("b")).distinct()
    # pass 3: spans that stand alone and one run of each that does not, where a group has any alone
    sizes = spans.groupBy("g").agg(F.count("*").alias("size"), F.min("many").alias("all")).where("size > 1 AND NOT all").select("g", "size")
    members = stash(spans.select("g", "many", "one.t1", "one.t2", "one.at", "one.n").join(stash(sizes), "g"))
    texts = texts_of(docs, members.select(*KEY).distinct())
    wanted = members.groupBy(*KEY).agg(F.collect_list(F.struct("g", "at", "n", "size", "many")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, r = batch.column(2)[i].as_py(), batch.column(3)[i].values
                at, n = r.field("at").to_numpy(), r.field("n").to_numpy()
                bits = [text[a : a + m - 1 + depth] for a, m in zip(at, n, strict=True)]
                t = [pa.array(np.full(len(at), batch.column(k)[i].as_py())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([r.field("g"), r.field("size"), *t, r.field("at"), r.field("many"), pa.array(bits, pa.binary())], ["g", "size", *KEY, "at", "many", "span"])

    cuts = texts.join(wanted, KEY).mapInArrow(cut, "g long, size long, t1 long, t2 long, at int, many boolean, span binary")
    cuts = stash(cuts) if members.where(F.col("size") > most).limit(1).count() else cuts
    small = cuts.where(F.col("size") <= most).repartition("g").sortWithinPartitions("g").select("g", *KEY, "at", "many", "span")

    def merged(t: tuple[np.ndarray, ...], at: np.ndarray, who: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """Ranges from repeated passages, consecutive ones as one."""
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (place[1:] != place[:-1] + 1)
        b = np.flatnonzero(new)
        e = np.append(b[1:], len(who)) - 1
        lo = at[who[b]] + place[b] if len(b) else np.zeros(0, np.int64)
        hi = at[who[b]] + place[e] + depth if len(b) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([*[pa.array(k[who[b]]) for k in t], pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], [*KEY, "a", "b"])

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, at in groups(batches, 1):
            step = 0
            while step < len(at) - 1:  # some groups at a time
                end = min(len(at) - 1, int(np.searchsorted(at, at[step] + most, "right")) - 1)
                end = max(end, step + 1)
                part = tab.slice(int(at[step]), int(at[end] - at[step]))
                buf, who, place, here = windows(part.column("span").combine_chunks(), depth)
                group = np.repeat(np.arange(end - step), np.diff(at[step : end + 1]))[who]
                dup = equal_passages(buf, here, group, depth) & ~part.column("many").to_numpy()[who]
                yield merged(tuple(part.column(k).to_numpy() for k in KEY), part.column("at").to_numpy().astype(np.int64), who[dup], place[dup])
                step = end

    found = found.unionByName(small.mapInArrow(last_pass, "t1 long, t2 long, a int, b int"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", *KEY, "many"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = pa.Table.from_batches([batch.slice(lo, 1000)])
                buf, who, place, here = windows(part.column("span").combine_chunks(), depth)
                h = digests(buf, here, here + depth)
                cols = [pa.array(part.column(c).to_numpy()[who]) for c in names]
                at = part.column("at").to_numpy()[who] + place
                yield pa.RecordBatch.from_arrays([*cols, pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(at.astype(np.int32))], [*names, "h1", "h2", "a"])

    if hasattr(cuts, "stashed_at"):
        large = stash(cuts.where(F.col("size") > most).select("g", *KEY, "at", "many", "span").mapInArrow(each, "g long, t1 long, t2 long, many boolean, h1 long, h2 long, a int"))
        common = stash(large.groupBy("g", "h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("g", "h1", "h2"))
        found = found.unionByName(large.where("not many").join(common, ["g", "h1", "h2"], "left_semi").select(*KEY, "a", (F.col("a") + depth).cast("int").alias("b")))
    return facts, found


def remove_repeats(docs: DataFrame, depth: int = 200, texts: bool = False, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, with ``texts``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts, spans = repeated_spans(docs, depth, **how)
    # a text that more than one row has is repeated as a whole, if it is long enough
    copies = facts.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("n_bytes").alias("size"))
    gone = stash(copies.where((F.col("copies") > 1) & (F.col("size") >= depth)).select(*KEY))
    ranges = stash(spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("ranges")).join(gone, KEY, "left_anti"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, r = batch.column(2)[i].as_py(), batch.column(3)[i].values
                a, b = r.field("a").to_numpy(), r.field("b").to_numpy()
                order = np.argsort(a, kind="stable")
                kept, end, removed, n = [], 0, 0, 0
                for lo, hi in zip(a[order].tolist(), b[order].tolist(), strict=True):
                    if n == 0 or lo > end:
                        kept.append(text[end:lo])
                        n += 1
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                kept.append(text[end:])
                left = b"".join(kept)
                out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), removed, n, hashlib.sha256(left).hexdigest(), left if texts else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*KEY, "removed", "spans", "rest", "kept"])

    done = texts_of(docs, ranges.select(*KEY)).join(ranges, KEY).mapInArrow(take, "t1 long, t2 long, removed long, spans long, rest string, kept binary")
    done = stash(done.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True))
    all_gone = F.coalesce("gone", F.lit(False))
    out = facts.join(done, KEY, "left")
    out = out.select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
        *([F.when(all_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
    return out


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
