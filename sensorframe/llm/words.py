"""Words of many texts at once, as 64-bit hashes, by numpy over the bytes of a column."""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_up: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _up:
        _up.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    return _up


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blank_separated() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words and lower case for words between blanks, tabs and line ends; A-Z are lowered."""
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return inside, lower


def letters_and_digits() -> tuple[np.ndarray, np.ndarray]:
    """As above for runs of letters, digits and bytes of other scripts."""
    inside = np.zeros(256, bool)
    for first, last in ((48, 58), (65, 91), (97, 123), (128, 256)):
        inside[first:last] = True
    return inside, blank_separated()[1]


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray], latin: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of the first word of each text (one more at the end).

    ``latin`` also lowers the capitals of two bytes that start with C3. Slices end between words, so memory
    does not grow with the length of a text, unless one word is longer than a slice.
    """
    inside, lower = tables
    up, down = _tables()
    starts = offsets[:-1][np.diff(offsets) > 0]
    hashes, first, begin = [], [], 0
    while begin < len(data):
        end = min(len(data), begin + SLICE)
        if end < len(data):
            cut = starts[np.searchsorted(starts, end, side="right") - 1]
            gaps = np.flatnonzero(~inside[data[begin:end]])
            best = max(cut if cut > begin else 0, begin + gaps[-1] + 1 if len(gaps) else 0)
            end = best if best > begin else end  # a word longer than a slice is cut
        part = lower[data[begin:end]]
        word = inside[data[begin:end]]
        if latin:
            high = np.flatnonzero((part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[:-1] == 0xC3) & (part[1:] != 0x97)) + 1
            part[high] += 32
        own = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, end)] - begin
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        head[own] = word[own]
        own = own[own > 0]
        tail[own - 1] = word[own - 1]
        at, to = np.flatnonzero(head), np.flatnonzero(tail) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        hashes.append(mix((total[to] - total[at]) * down[at]))
        first.append(at + begin)
        begin = end
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.concatenate(first) if first else np.zeros(0, np.int64)
    return hashes, np.searchsorted(first, offsets)
