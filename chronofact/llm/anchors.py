"""Content-chosen anchors of fixed-length windows, over many texts at once."""

from __future__ import annotations

import numpy as np

from chronofact.llm.shingles import mixed, powers

GRAM = 32
_PLACE_BITS = 22


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by running minima of blocks from both sides."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, anchor place, anchor hash) of the runs of windows of ``length`` bytes that share an anchor, windows in one text.

    data holds texts from starts to ends. A window's anchor is its 32-byte gram of least hash, the first of equals:
    windows equal in bytes have equal anchors at equal places. Consecutive windows of a text with the same anchor are
    one run, of windows starting at first, ..., first + count - 1. A run's windows lie in first .. first + count - 1 + length.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(np.uint64)
    power, inverse = powers(1 << (len(raw) + 1).bit_length())
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    n = len(raw) - GRAM + 1
    gram = mixed((total[GRAM:] - total[:n]) * inverse[:n])
    place = np.uint64((1 << _PLACE_BITS) - 1)
    key = (gram & ~place) | np.arange(n, dtype=np.uint64)
    anchor = (_sliding_min(key, length - GRAM + 1) & place).astype(np.int64)
    windows = len(raw) - length + 1
    inside = np.zeros(windows + 1, dtype=np.int8)
    good = ends - starts >= length
    np.add.at(inside, starts[good], 1)
    np.add.at(inside, ends[good] - length + 1, -1)
    inside = np.cumsum(inside[:windows]) > 0
    edge = np.ones(windows, dtype=bool)
    edge[1:] = anchor[1:] != anchor[:-1]
    edge[starts[good]] = True
    first = np.flatnonzero(edge & inside)
    stop = np.append(np.flatnonzero(edge), windows)
    nexts = stop[np.searchsorted(stop, first, side="right")]
    of = np.flatnonzero(good)
    last_of_text = ends[of[np.searchsorted(starts[of], first, side="right") - 1]] - length + 1
    return first, np.minimum(nexts, last_of_text) - first, anchor[first], gram[anchor[first]]
