"""Words and distinct three-word runs of texts, as arrays of hashes.

A word is a maximal run of letters and digits, in lower case. Words are compared by 64-bit hashes, runs by 48-bit ones:
two texts of a hundred runs each share one by chance in one of 10**10 comparisons.
"""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
RUN = 3
LEAST_WORDS = 12
RUN_BITS = 48
#: Characters that are hashed at a time, about, and texts whose runs are sorted at a time.
WINDOW, SLAB = 1 << 18, 1 << 16

_M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}


#: Of the ASCII characters, spaces for all but letters and digits.
_SPACED = {i: " " for i in range(128) if not chr(i).isalnum()}


def words(text: str) -> list[str]:
    text = text.lower()
    return text.translate(_SPACED).split() if text.isascii() else WORD.findall(text)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(most: int) -> np.ndarray:
    """A random number for each character up to `most` that may be part of a word (of ASCII ones that of the lower-case letter), else 0."""
    n = next(x for x in (0x80, 0x3000, 0x20000, 0x110000) if most < x)
    if f"values {n}" not in _TABLES:
        value = mix(np.arange(1, n + 1, dtype=np.uint64) * _M1)
        value[[not chr(i).isalnum() for i in range(n)]] = 0
        value[65:91] = value[97:123]
        _TABLES[f"values {n}"] = value
    return _TABLES[f"values {n}"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, n at least."""
    if len(_TABLES.get("powers", ())) < n:
        for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.multiply.accumulate(steps)
    return _TABLES["powers"], _TABLES["inverses"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each; a null text has none.

    A word's hash is the sum of its characters' numbers times the powers of a base, read off the running sums of a
    window that ends between words.
    """
    kept = [t or "" for t in texts]
    joined = " ".join(kept)
    if joined.isascii():
        codes, value = np.frombuffer(joined.encode(), np.uint8), _values(0x7F)
    else:
        kept = [t.lower() for t in kept]
        codes = np.frombuffer(" ".join(kept).encode("utf-32-le"), "<u4")
        value = _values(int(codes.max()))
    found, places, lo = [], [], 0
    while lo < len(codes):
        part = value[codes[lo : lo + WINDOW]]
        if lo + len(part) < len(codes) and part[-1]:
            gaps = np.flatnonzero(part == 0)
            if len(gaps):
                part = part[: gaps[-1] + 1]
            else:  # one word fills the window
                rest = next((i for i in range(lo + WINDOW, len(codes)) if not value[codes[i]]), len(codes))
                part = value[codes[lo:rest]]
        power, inverse = _powers(max(WINDOW, len(part)))
        inside = part != 0
        edge = np.empty(len(part) + 1, bool)
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edges = np.flatnonzero(edge)
        start, end = edges[::2], edges[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        found.append(mix((total[end] - total[start]) * inverse[start]))
        places.append(start + lo)
        lo += len(part)
    begins = np.cumsum([0, *(len(t) + 1 for t in kept)])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(places), begins))


def run_hashes(word: np.ndarray) -> np.ndarray:
    """The hash of every three neighbouring words."""
    if len(word) < RUN:
        return np.zeros(0, np.uint64)
    return mix(mix(word[:-2] * _M1 + word[1:-1]) * _M2 + word[2:]) >> np.uint64(64 - RUN_BITS)


def sorted_by(cell: np.ndarray) -> np.ndarray:
    """The places of the array in the order of its values, equal ones in the order they stand in."""
    bits = max(1, len(cell).bit_length())
    if len(cell) and int(cell.max()) >> (63 - bits):
        return np.argsort(cell, kind="stable")
    return np.sort((cell.astype(np.int64) << bits) | np.arange(len(cell))) & ((1 << bits) - 1)


def run_sets(texts: list[str | None], least: int = LEAST_WORDS, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, run, sizes): the distinct runs of each text of at least `least` words, sorted by text and run. hashed are the
    texts' word_hashes, if they are known."""
    if len(texts) > SLAB:
        parts = [run_sets(texts[lo : lo + SLAB], least) for lo in range(0, len(texts), SLAB)]
        return np.concatenate([doc + i * SLAB for i, (doc, _, _) in enumerate(parts)]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    word, counts = hashed or word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(word) < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    run = run_hashes(word)
    keep = (doc[:-2] == doc[2:]) & (counts[doc[:-2]] >= least)
    both = np.sort((doc[:-2][keep].astype(np.uint64) << np.uint64(RUN_BITS)) | run[keep])
    first = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=first[1:])
    both = both[first]
    doc = (both >> np.uint64(RUN_BITS)).astype(np.int64)
    return doc, both & np.uint64((1 << RUN_BITS) - 1), np.bincount(doc, minlength=len(texts))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; x is sorted in place."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def alike_pairs(x: np.ndarray, y: np.ndarray, run: np.ndarray, sizes: np.ndarray, other: tuple[np.ndarray, np.ndarray] | None = None, share: float = 0.5) -> np.ndarray:
    """Whether the sets x of (run, sizes) and y of the same, or of other = (run, sizes), share at least `share` of their union."""
    run2, sizes2 = other or (run, sizes)
    first, first2 = np.cumsum(sizes) - sizes, np.cumsum(sizes2) - sizes2
    out = np.zeros(len(x), bool)
    weight, lo = np.cumsum(sizes[x] + sizes2[y]), 0
    while lo < len(x):  # some two million runs at a time, and pairs that 16 bits count
        hi = min(lo + 60_000, max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + 2_000_000, side="right"))))
        a, b = x[lo:hi], y[lo:hi]
        pair = np.arange(hi - lo, dtype=np.uint64) << np.uint64(RUN_BITS)
        both = np.sort(np.concatenate([np.repeat(pair, sizes[a]) | run[spans(first[a], sizes[a])], np.repeat(pair, sizes2[b]) | run2[spans(first2[b], sizes2[b])]]))
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(RUN_BITS)).astype(np.int64), minlength=hi - lo)
        out[lo:hi] = (common > 0) & (common >= share * (sizes[a] + sizes2[b] - common))
        lo = hi
    return out
