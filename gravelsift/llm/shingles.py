"""Sets of word shingles as numbers, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Texts are read so many characters at a time.
CHARS = 300_000
#: Powers that a worker keeps; those for longer texts are made anew.
KEPT = 1 << 20
#: Bits of a token in the sorted keys of `token_sets`; the rest number the text.
TOKEN_BITS = 44

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _word_table() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(1 << 16)])


_WORD = _word_table()
_kept: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base, and their inverses, for texts of n characters."""
    if _kept and len(_kept[0]) >= n:
        return _kept
    made = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, dtype=np.uint64)])) for x in (_BASE, _INVERSE)]
    if len(made[0]) <= KEPT:
        _kept[:] = made
    return made


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHARS characters, each with its first place."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars > CHARS:
            yield start, texts[start : i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every run of WORDS lower-case words; a text of fewer words has one shingle of them all."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    powers, inverses = _powers(len(points) + 1)
    word = np.where(points < 1 << 16, _WORD[np.minimum(points, 0xFFFF)], True)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * powers[: len(points)], dtype=np.uint64)])
    hashed = mix((total[end] - total[start]) * inverses[start])
    begins = np.cumsum([0, *(len(t) + 1 for t in lower)])
    owner = np.searchsorted(begins, start, side="right") - 1
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(start)) - first[owner]
    keep = np.flatnonzero((place + WORDS <= n[owner]) | ((place == 0) & (n[owner] < WORDS)))
    out = n[owner[keep]].astype(np.uint64)
    out[n[owner[keep]] >= WORDS] = WORDS
    for k in range(WORDS):
        at = keep + k
        there = place[keep] + k < n[owner[keep]]
        out = mix(out * np.uint64(31) + np.where(there, hashed[np.minimum(at, len(hashed) - 1)], np.uint64(0)))
    return owner[keep], out


def token_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) with each text's distinct shingles, sorted; tokens have TOKEN_BITS bits."""
    return compacted(*shingles(texts))


def compacted(owner: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of shingles: distinct, sorted, of TOKEN_BITS bits."""
    keys = np.sort(owner.astype(np.uint64) << np.uint64(TOKEN_BITS) | made >> np.uint64(64 - TOKEN_BITS))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return (keys >> np.uint64(TOKEN_BITS)).astype(np.int64), keys & np.uint64((1 << TOKEN_BITS) - 1)


def fingerprints(token: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each text's distinct tokens, whose places are cut[k] to cut[k + 1]: equal for equal sets."""
    added = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token + np.uint64(11)), dtype=np.uint64)])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token ^ np.uint64(0xABCDEF0123456789)), dtype=np.uint64)])
    return (added[cut[1:]] - added[cut[:-1]]).astype(np.int64), (other[cut[1:]] - other[cut[:-1]]).astype(np.int64)
