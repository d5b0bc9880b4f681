"""Document statistics for the linear models, from bytes and word hashes alone."""

from __future__ import annotations

import numpy as np

from verisieve.llm.textvec import row_sums, words

NAMES = (
    "log_bytes", "log_words", "upper", "lower", "digit", "symbol", "bang", "bar", "stop", "high", "newline", "mean_word",
    "repeat", "repeat2", "distinct", "symbol_words", "upper_words", "bar_words", "bang_words", "long_words", "digit_words",
    "sqrt_symbol_words", "sqrt_upper_words", "sqrt_bar_words", "sqrt_repeat", "line_words", "repeat_per_word_log",
)
UPPER, LOWER_, DIGIT, SYMBOL, BANG, BAR, STOP, NEWLINE = range(8)
_class = np.full(256, 255, np.uint8)
_class[65:91] = UPPER
_class[97:123] = LOWER_
_class[48:58] = DIGIT
for _c in b"#$%&*@^~=<>{}[]\\_+":
    _class[_c] = SYMBOL
_class[ord("!")] = BANG
_class[ord("|")] = BAR
for _c in b".,;:?":
    _class[_c] = STOP
_class[10] = NEWLINE


def describe(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each document; an empty one has zeros."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    least = np.maximum(size, 1)
    kind = _class[buf]
    bounds = off
    count = {k: row_sums(kind == k, bounds) for k in range(8)}
    high = row_sums(buf >= 128, bounds)
    start, end, h, to = words(buf, off)
    nw = np.diff(to).astype(np.float64)
    lw = np.maximum(nw, 1)
    doc = np.repeat(np.arange(n), np.diff(to))
    last = kind[end - 1] if len(end) else kind[:0]
    first = kind[start] if len(start) else kind[:0]
    length = end - start
    second = kind[np.minimum(start + 1, end - 1)] if len(start) else kind[:0]
    same = np.zeros(len(h), bool)
    same2 = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    same2[2:] = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2])
    key = np.sort((h & np.uint64((1 << 40) - 1)) | (doc.astype(np.uint64) << np.uint64(40)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) if len(key) else np.zeros(n)
    per = lambda flags: row_sums(flags, to) / lw
    symbol_words = per((last == SYMBOL) & (length > 1))
    upper_words = per((first == UPPER) & (second == UPPER) & (length > 1))
    bar_words = per((last == BAR) & (length == 1))
    repeat = per(same)
    out = np.column_stack([
        np.log1p(size), np.log1p(nw), count[UPPER] / least, count[LOWER_] / least, count[DIGIT] / least, count[SYMBOL] / least, count[BANG] / least, count[BAR] / least,
        count[STOP] / lw, high / least, count[NEWLINE] / lw, row_sums(length, to) / lw, repeat, per(same2), distinct / lw, symbol_words, upper_words, bar_words,
        per((last == BANG) & (length > 1)), per(length > 18), per(first == DIGIT), np.sqrt(symbol_words), np.sqrt(upper_words), np.sqrt(bar_words), np.sqrt(repeat),
        np.log1p(nw / (count[NEWLINE] + 1)), np.log1p(row_sums(same, to)),
    ])
    out[size == 0] = 0
    return out
