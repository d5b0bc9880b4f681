"""Packing of tokenised documents into sequences by bounded-space online best-fit.

A document is its byte-pair ids followed by an end id. One that is longer than a sequence is cut
into pieces as long as a sequence, of which the first may be shorter; no other is cut.

Pieces are dealt by hash to shards of a bounded number of tokens, and within a shard to lots of
about ``lot`` pieces, which come one after another, the longest piece of a lot first. (Among 11,562
pieces of sf0.1, which need 4,936 sequences, lots of 2,048 leave 1 more, order by hash alone 49.)
Each piece goes to the open bin with the least free space that still takes it. The open bins' free spaces are bits of one integer, so that bin is the lowest
bit from the piece's length on. A piece that fits nowhere opens a bin; if ``open_bins`` are open
already, the fullest (the lowest bit of all) is closed first. Bins without space close at once.
Pieces in bins that are still open when a shard ends are dealt again to an ``merged``-th of the
shards, until there is one; so a shard's last bins are not left half empty, no task holds more
than its open bins, and the last task reads no more than the open bins of ``merged`` shards.
A piece's shard, order and place follow from its row alone: a task that is run again packs alike.

Ids come from tiktoken with the ranks of the vocabulary file of ``tokenizers``, which gives the
same ids in a fifth of the time; what it cannot encode goes to ``tokenizers``. Long texts are
encoded in stretches that end before a single space, where no token spans the cut. The strings of
special tokens are ordinary text.

A null text is empty: its only id is the end id. Null and repeated doc_ids and repeated rows are
documents of their own. An empty table gives no rows. Other columns are ignored, clashing names included.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verisieve.llm.common import stash, table

CAPACITY, END = 2048, 0
#: The split of byte-level vocabularies of this kind before merges (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STRETCH = 1 << 18
_single_space = re.compile(r"(?<=\S) (?=\S)")


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is visible
    Latin-1, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _plain(vocabulary: str) -> Tokenizer:
    out = Tokenizer.from_file(vocabulary)
    out.encode_special_tokens = True
    return out


@lru_cache(maxsize=2)
def _fast(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, encoding="utf-8") as f:
        held = json.load(f)
    letters, special = _letters(), {t["content"] for t in held["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): n for word, n in held["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in stretches of about ``size``, cut before a space between two other characters."""
    at = 0
    while len(text) - at > size:
        found = _single_space.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_ids(text: str, vocabulary: str) -> array.array:
    out = array.array("I")
    for s in stretches(text):
        try:
            out.extend(_fast(vocabulary).encode_ordinary(s))
        except BaseException as e:  # a panic of the library is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            out.extend(_plain(vocabulary).encode(s, add_special_tokens=False).ids)
    return out


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, where asked for, the ``ids``."""
    path = vocabulary or public_vocabulary()
    kind = dict(docs.dtypes)["doc_id"]
    more = ", ids array<int>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(b.column("text")):
                ids = token_ids(text.as_py() or "", path)
                ids.append(end)
                raw = np.frombuffer(ids, np.uintc).astype("<u4")
                first = (len(raw) - 1) % capacity + 1
                for n, at in enumerate([0, *range(first, len(raw), capacity)]):
                    to = first if n == 0 else at + capacity
                    doc.append(row), piece.append(n), start.append(at), length.append(to - at), crc.append(zlib.crc32(raw[at:to].tobytes()))
                    if keep_ids:
                        kept.append(raw[at:to].astype(np.int32))
            columns = [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}")


class Bins:
    """Open bins of one shard, by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f: a bin with free space f is open
        self.of: dict[int, list[list[tuple[int, int]]]] = {}
        self.count = 0

    def add(self, item: int, length: int) -> list[tuple[int, int]] | None:
        """Place an item; the bin that this closes, if one."""
        if length == self.capacity:
            return [(item, length)]
        closed = None
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            held = self._take(space)
        else:
            if self.count == self.most:
                closed = self._take((self.free & -self.free).bit_length() - 1)
            space, held = self.capacity, []
        held.append((item, length))
        if space == length:
            return held
        self._put(space - length, held)
        return closed

    def _take(self, space: int) -> list[tuple[int, int]]:
        bins = self.of[space]
        out = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.count -= 1
        return out

    def _put(self, space: int, held: list[tuple[int, int]]) -> None:
        self.of.setdefault(space, []).append(held)
        self.free |= 1 << space
        self.count += 1

    def rest(self) -> list[list[tuple[int, int]]]:
        return [held for space in sorted(self.of) for held in self.of[space]]


PLACED = pa.schema([("item", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_())])


def _packed(items: DataFrame, shards: int, lots: int, turn: int, capacity: int, open_bins: int) -> DataFrame:
    """``items`` (item, length) with their places; ``closed`` is false in bins still open at a shard's end."""
    last = shards == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, made = None, None, 0
        out: list[tuple[int, int, int, int, bool]] = []

        def put(held: list[tuple[int, int]], closed: bool) -> None:
            nonlocal made
            name, at = turn << 58 | now << 32 | made, 0
            made += 1
            for item, length in held:
                out.append((item, length, name, at, closed))
                at += length

        def end() -> None:
            for held in bins.rest():
                put(held, last)

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), PLACED, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=PLACED)

        for b in batches:
            for shard, item, length in zip(*(b.column(c).to_pylist() for c in ("shard", "item", "length")), strict=True):
                if shard != now:
                    if bins is not None:
                        end()
                    now, bins, made = shard, Bins(capacity, open_bins), 0
                full = bins.add(item, length)
                if full is not None:
                    put(full, True)
                if len(out) >= 5000:
                    yield batch()
        if bins is not None:
            end()
        if out:
            yield batch()

    h = F.xxhash64("item", F.lit(turn))
    dealt = items.select(F.pmod(h, F.lit(shards)).alias("shard"), F.pmod(F.shiftrightunsigned(h, 24), F.lit(lots)).alias("lot"), "item", "length")
    parts = min(shards, max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "lot", F.desc("length"), "item")
    return ordered.mapInArrow(run, "item long, length long, sequence_id long, offset long, closed boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = 1024, lot: int = 2048, shard_tokens: int = 1 << 24, merged: int = 8) -> DataFrame:
    """``item, sequence_id, offset`` for items (distinct long ``item``, ``length`` of 1 to ``capacity``)."""
    shards, turn, done = None, 0, []
    while True:
        n, tokens = items.agg(F.count("*"), F.sum("length")).head()
        shards = max(1, -(-(tokens or 0) // shard_tokens)) if shards is None else -(-shards // merged)
        placed = stash(_packed(items, shards, max(1, n // (shards * lot)), turn, capacity, open_bins))
        done.append(placed.where("closed").select("item", "sequence_id", "offset"))
        if shards == 1:
            return reduce(DataFrame.unionByName, done)
        items, turn = placed.where("NOT closed").select("item", "length"), turn + 1


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: its document, place in it, length, CRC of its ids (and with
    ``keep_ids`` the ``ids``), and its place: ``sequence_id, offset``."""
    pieces = stash(token_pieces(docs, vocabulary, capacity, keep_ids=keep_ids).withColumn("item", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces.select("item", "length"), capacity, open_bins), "item").drop("item")


def sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = 1024) -> DataFrame:
    """``sequence_id, ids``: the packed sequences; a group is one sequence."""
    placed = pack_documents(docs, vocabulary, capacity, open_bins, keep_ids=True)
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
