"""Word sequences, 64-bit shingle hashes and min-hash signatures (executor side, numpy).

Words are the longest runs of letters and digits of the lower-cased text. A shingle is a
sequence of ``n`` consecutive words; a text of fewer words than ``n``, but at least one, has
its whole word sequence as its only shingle, so that identical short texts still match. A
text without any word has no shingle and is similar to nothing.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHasher:
    """64-bit hashes of words, remembered for the ``keep`` most recent distinct words."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            h = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = h(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each position at which ``n`` words begin (all words, if fewer)."""
    if not len(word_hashes):
        return np.empty(0, np.uint64)
    n = min(n, len(word_hashes))
    m = len(word_hashes) - n + 1
    with np.errstate(over="ignore"):
        x = _mix(word_hashes[:m] + np.uint64(n))
        for i in range(1, n):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : i + m])
    return x


@functools.lru_cache(maxsize=4)
def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, count, dtype=np.uint32)


def minhashes(distinct: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """``count`` 32-bit min-hashes of a set of 64-bit shingle hashes."""
    a, b = _functions(count, seed)
    low, high = distinct.astype(np.uint32), (distinct >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 512):  # blocks that stay in the processor's cache
            x = low[at : at + 512, None] * a + b
            x ^= high[at : at + 512, None]
            x *= np.uint32(0x85EBCA6B)
            np.minimum(out, x.min(axis=0), out=out)
    return out


def sketch_words(mins: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of each of the first ``bits`` / 2 min-hashes, packed into 64-bit integers.

    Two texts of similarity s agree in a bit with probability (1 + s) / 2.
    """
    top = mins[: bits // 2]
    bit = np.concatenate(((top >> np.uint32(13)) & np.uint32(1), (top >> np.uint32(22)) & np.uint32(1)))
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def sequence_digest(words: list[str]) -> bytes:
    """128-bit digest of a word sequence: equal for texts of the same words in the same order."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
