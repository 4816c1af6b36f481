"""Words of UTF-8 bytes as 64-bit hashes, for whole batches at a time.

A word is a run of bytes outside a set of ASCII separators; bytes from 0x80 on always belong to words, so a character
is never cut. The hash of a word is a polynomial over random 64-bit values of its bytes, taken from prefix sums
modulo 2**64, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from spindrel.llm.common import slices

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 19

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _table(separators: np.ndarray) -> np.ndarray:
    """Byte to folded byte; 0 for a separator."""
    table = _FOLD.copy()
    table[separators] = 0
    return table


#: Words [^\x20\x09-\x0D]+ after lower-casing A-Z; NUL is no separator there and gets a value that no text has.
SPACED = _table(np.array([32, 9, 10, 11, 12, 13]))
SPACED[0] = 0xFF
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = _table(np.array([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_RANDOM = np.random.default_rng(20240611).integers(1 << 32, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
_M1, _M2, _S32, _S29 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits; changes x."""
    x ^= x >> _S32
    x *= _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
        if n > 16 * CHUNK:
            up, down = _powers["up"], _powers["down"]
            _powers.clear()
            return up, down
    return _powers["up"], _powers["down"]


def hashed(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) of texts data[offsets[i]:offsets[i + 1]]."""
    starts, ends, firsts, folded = spans(data, offsets, table)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    up, down = _power(len(folded) + 1)
    sums = np.empty(len(folded) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_RANDOM[folded] * up[: len(folded)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), firsts


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start and end byte of each word, first word of each text and the end, folded bytes)."""
    folded = table[data]
    inside = folded != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # texts that meet without a separator
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]), kind="stable")
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets), folded


def chunks(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, first word of each text and the end), chunk by chunk."""
    for i, j in slices(offsets, CHUNK):
        part = offsets[i : j + 1]
        yield i, *hashed(data[part[0] : part[-1]], part - part[0], table)


_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of `size` words, at most 5; runs over the end of a text are for the caller to leave out."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _WEIGHTS[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, sorted distinct shingle hashes). Fewer words than size, but not none, are one shingle."""
    for first, words, at in chunks(data, offsets, SPACED):
        every = shingles(words, size)
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b - a >= size:
                one = np.sort(every[a : b - size + 1])
                keep = np.empty(len(one), bool)
                keep[0] = True
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                yield first + k, one[keep]
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in words[a:b]:
                        whole = whole * _WEIGHTS[0] + x
                yield first + k, mix(np.array([whole], np.uint64))
            else:
                yield first + k, words[:0]
