"""Whole-batch text kernels on numpy byte arrays.

A batch of documents is one byte buffer with offsets. Word boundaries and word
hashes of all documents come from a few array passes, with no Python object for
each word. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with
A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes: first row, end row, bytes, offsets."""
    buf, off = as_bytes(column)
    first, n = 0, len(off) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, buf[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def prefix_code(buf: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = sum of code(b[k]) * BASE**k over i <= k < j, modulo 2**64."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODE[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end), alike wherever a run stands."""
    return mix((code[end] - code[start]) * powers(INVERSE, len(code))[start])


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 128 bits of the SHA-256 of each byte run [start, end), as two int64 columns."""
    raw = buf.tobytes()
    got = b"".join([hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(got, np.int64).reshape(-1, 2)


#: Longer words are hashed by BLAKE2: polynomials modulo 2**64 collide on long regular strings.
LONG_WORD = 64


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True, apart: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes, and where each row's words begin (rows + 1 places).

    ``apart`` marks the bytes that stand between words."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    blank = apart[buf]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = blank
    after = np.empty(n + 1, bool)
    after[:n] = blank
    after[n] = True
    before[off] = True
    after[off] = True
    start = np.flatnonzero(before[:n] & ~blank)
    end = np.flatnonzero(after[1:] & ~blank) + 1
    text = LOWER[buf] if lower else buf
    h = span_hash(prefix_code(text), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return start, end, h, np.searchsorted(start, off)


def plain_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words, lower-cased, with one space between them: bytes and offsets."""
    n = len(buf)
    blank = WS[buf]
    keep = ~blank
    if n:
        before = np.empty(n, bool)  # a blank, or the start of the row, stands before
        before[1:] = blank[:-1]
        before[0] = True
        at = np.flatnonzero(keep & before)  # word starts after a blank
        inner = at[at > off[np.searchsorted(off, at, "right") - 1]]
        first = np.full(len(off), n)
        filled = np.flatnonzero(keep)
        place = np.searchsorted(filled, off)
        first[place < len(filled)] = filled[place[place < len(filled)]]
        inner = inner[inner != first[np.searchsorted(off, inner, "right") - 1]]
        keep[inner - 1] = True
    out = np.where(blank, np.uint8(32), LOWER[buf])[keep]
    return out, np.append(0, np.cumsum(keep))[off]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty rows are 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
