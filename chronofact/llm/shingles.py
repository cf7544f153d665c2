"""Word hashes and shingle sets of whole texts, computed over many documents at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes hashed at once; longer texts are cut at white space.
CHUNK = 1 << 20
_FOLD = np.arange(256, dtype=np.uint64) + 1
_FOLD[65:91] = _FOLD[97:123]
_WORD = np.ones(256, dtype=bool)
_WORD[[32, *range(9, 14)]] = False


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in data, A-Z folded."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = _WORD[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = powers(max(CHUNK + 1, 1 << (len(raw) + 1).bit_length()))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_FOLD[raw] * power[: len(raw)], out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * inverse[starts])


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """A 64-bit hash for each word of each text, in order."""
    group: list[bytes] = []
    size = 0

    def done() -> Iterator[np.ndarray]:
        starts, h = _hashes(b"\n".join(group))
        at = np.cumsum([0, *(len(t) + 1 for t in group)])
        cut = np.searchsorted(starts, at)
        for i in range(len(group)):
            yield h[cut[i] : cut[i + 1]]

    for t in texts:
        if len(t) > CHUNK:
            if group:
                yield from done()
                group, size = [], 0
            parts, at = [], 0
            while at < len(t):
                m = _BREAK.search(t, at + CHUNK)
                end = m.start() if m else len(t)
                parts.append(_hashes(t[at:end])[1])
                at = end
            yield np.concatenate(parts)
            continue
        if group and size + len(t) > CHUNK:
            yield from done()
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield from done()


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, the whole sequence is one; of none, none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, np.uint64(min(len(words), width)))
    for i in range(min(len(words), width)):
        out = mixed(out * np.uint64(_BASE) + words[i : i + n])
    return np.unique(out)
