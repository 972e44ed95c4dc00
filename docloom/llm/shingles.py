"""Word shingles of blocks of texts as 64-bit hashes, in numpy.

Words are [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes with A-Z in lower case. A shingle is n consecutive
words; a text with fewer words is one shingle as a whole; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POWERS = np.ones(1, np.uint64)

#: Bytes of text that are hashed together.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _BASE))])
    return _POWERS


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the number of the text it is in."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    solid = ~_BLANK[buf]
    at = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    doc = np.searchsorted(starts, at, side="right") - 1
    kept = _LOWER[buf[solid]]
    begin = np.searchsorted(np.flatnonzero(solid), at)
    size = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, size)
    sums = np.add.reduceat(_BYTE[kept] * _powers(int(size.max()) + 1)[place], begin)
    return mix(sums + size.astype(np.uint64) * _BASE), doc


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text: (hashes, text numbers), sorted by text and hash."""
    words, doc = word_hashes(texts)
    if not len(words):
        return words, doc
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= n:
        last = len(words) - n + 1
        sums = np.zeros(last, np.uint64)
        for j in range(n):
            sums += words[j : j + last] * _WORD[j % len(_WORD)]
        whole = doc[:last] == doc[n - 1 :]
        hashes, owner = sums[whole], doc[:last][whole]
    counts = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(doc, short)
        few = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = counts[short] > j
            few[has] += words[first[has] + j] * _WORD[j % len(_WORD)]
        hashes = np.concatenate([hashes, few + counts[short].astype(np.uint64) * _BASE])
        owner = np.concatenate([owner, short])
    hashes = mix(hashes)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    return hashes[new], owner[new]


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` characters of text."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
