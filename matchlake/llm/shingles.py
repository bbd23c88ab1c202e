"""Vectorised word and shingle hashing inside Arrow batches.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR, after lower-casing A-Z only; both are
what ``bytes.lower`` and ASCII white space mean, so the work is done on UTF-8 bytes without decoding. A word's
64-bit value is a keyed polynomial of its bytes, finished by a bijective mix; a shingle's is a keyed sum of the
values of its words, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of each word in ``buf``."""
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    inside = np.flatnonzero(word)
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    offset = np.arange(len(inside)) - np.repeat(at, lens)
    power = np.cumprod(np.full(int(lens.max()), _BASE, dtype=np.uint64))
    value = np.add.reduceat(_BYTE[buf[inside]] * power[offset], at)
    return starts, mix(value + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _pieces(text: bytes) -> Iterator[bytes]:
    """Cuts of a very long text at white space."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        while hi < len(text) and not _SPACE[text[hi]]:
            hi += 1
        yield text[lo:hi]
        lo = hi


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text, in order; texts are taken together up to a piece's size."""
    out: list[np.ndarray] = []
    hold: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal hold, size
        if hold:
            starts, hashes = _hash_piece(np.frombuffer(b"\n".join(hold), dtype=np.uint8))
            cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in hold])[:-1])
            out.extend(np.split(hashes, cuts))
            hold, size = [], 0

    for text in texts:
        text = text.lower()
        if len(text) > PIECE:
            flush()
            out.append(np.concatenate([_hash_piece(np.frombuffer(p, dtype=np.uint8))[1] for p in _pieces(text)]))
            continue
        hold.append(text)
        size += len(text)
        if size > PIECE:
            flush()
    flush()
    return out


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text counts as one shingle, none as the empty set."""
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    keys = mix(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    total = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        total = total + words[i : n - width + 1 + i] * keys[i]
    return np.unique(mix(total))
