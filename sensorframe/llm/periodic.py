"""Periodic runs of words: block convolution finds distances at which blocks come again, and these seed extensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A prime of the form k * 2^23 + 1 with the primitive root 3: transforms of up to 2^23 numbers are exact.
PRIME, ROOT = 998_244_353, 3
# Words of several texts that are worked on together, and numbers of a transform at a time.
BATCH = 1 << 18
CHUNK = 1 << 20


@lru_cache(maxsize=64)
def _twiddles(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to ``half`` - 1 of a primitive root of order 2 * ``half``."""
    root = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row, in bit-reversed order; the length is a power of two."""
    x, p = x.astype(np.uint64), np.uint64(PRIME)
    half = x.shape[1] // 2
    while half:
        pairs = x.reshape(len(x), -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        total = low + high
        high[...] = (low + p - high) * _twiddles(half, False) % p
        low[...] = np.where(total >= p, total - p, total)
        half //= 2
    return x


def transform_back(x: np.ndarray) -> np.ndarray:
    """The inverse, from bit-reversed order; changes its argument."""
    p, n, half = np.uint64(PRIME), x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        turned = high * _twiddles(half, True) % p
        total, left = low + turned, low + p - turned
        low[...] = np.where(total >= p, total - p, total)
        high[...] = np.where(left >= p, left - p, left)
        half *= 2
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block of length L stands in its window of length 2 L - 1: a boolean for each of L places.

    The sum of squared differences at every place is a sum of squares less twice a correlation. Numbers are cut
    into digits so small that the sum is below the prime, so a sum of zero is a place without a mismatch, exactly.
    """
    rows, size = blocks.shape
    bits = 1
    while size * ((1 << (bits + 1)) - 1) ** 2 < PRIME:
        bits += 1
    same = np.ones((rows, size), bool)
    top = int(max(blocks.max(initial=0), windows.max(initial=0)))
    for shift in range(0, max(top.bit_length(), 1), bits):
        x, y = ((v >> shift) & ((1 << bits) - 1) for v in (blocks, windows))
        padded = np.zeros((2, rows, 2 * size), np.uint64)
        padded[0, :, :size] = x[:, ::-1]
        padded[1, :, : 2 * size - 1] = y
        both = transform(padded.reshape(2 * rows, -1)).reshape(2, rows, -1)
        product = transform_back(both[0] * both[1] % np.uint64(PRIME))[:, size - 1 : 2 * size - 1].astype(np.int64)
        squares = np.zeros((rows, 2 * size), np.int64)
        np.cumsum(y.astype(np.int64) ** 2, axis=1, out=squares[:, 1:])
        windowed = squares[:, size:] - squares[:, :size]
        total = (x.astype(np.int64) ** 2).sum(axis=1)[:, None] + windowed - 2 * product
        same &= total % PRIME == 0
    return same


def _stretches(keep: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the maximal stretches of kept places within one part."""
    edge = np.ones(len(keep) + 1, bool)
    edge[1:-1] = part[1:] != part[:-1]
    before, after = np.concatenate([[False], keep]), np.concatenate([keep, [False]])
    first = np.flatnonzero(after & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~after))
    return first, end


def _candidates(code: np.ndarray, doc: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of stretches outside which no word is in a run.

    A word of a run comes at least ``repeats`` times in it. So words that are rarer in their text part stretches,
    and the same holds within each stretch, again and again.
    """
    keep = np.bincount(code)[code] >= repeats if len(code) else np.zeros(0, bool)
    first, end = _stretches(keep, doc)
    while True:
        long = end - first >= least
        first, end = first[long], end[long]
        place = _ranges(first, end - first)
        part = np.repeat(np.arange(len(first)), end - first)
        _, group, n = np.unique(part * (int(code.max(initial=0)) + 1) + code[place], return_inverse=True, return_counts=True)
        keep = n[group] >= repeats
        if keep.all():
            return first, end
        still = np.zeros(len(code), bool)
        still[place[keep]] = True
        mark = np.full(len(code), -1)
        mark[place] = part
        first, end = _stretches(still, mark)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    if not len(first):
        return np.zeros(0, np.int64)
    return np.arange(size.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


def _seeds(x: np.ndarray, first: np.ndarray, end: np.ndarray, size: int, pad: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretch, start and distance of every block of ``size`` words that comes again ``size`` to 2 * ``size`` - 1 words on."""
    n = np.maximum((end - first) // size - 1, 0)
    owner = np.repeat(np.arange(len(first)), n)
    start = _ranges(np.zeros(len(first), np.int64), n) * size + first[owner]
    step = max(1, CHUNK // (4 * size))
    for a in range(0, len(start), step):
        s, o = start[a : a + step], owner[a : a + step]
        at = s[:, None] + size + np.arange(2 * size - 1)
        inside = at < end[o][:, None]
        windows = np.where(inside, x[np.where(inside, at, 0)], pad)
        row, distance = np.nonzero(occurrences(x[s[:, None] + np.arange(size)], windows))
        yield o[row], s[row], distance + size


def find_runs(code: np.ndarray, doc: np.ndarray, least: int = 6, repeats: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the periodic runs of several texts at once, by start and period.

    ``code`` numbers the words, differently in each text; ``doc`` is the text of each place. A run is a maximal
    stretch with smallest period q and a length of at least ``least`` and ``repeats`` * q.

    At each scale L = 1, 2, 4, ... the stretches are cut into blocks of L words, and every block's next places are
    found at distances L to 2 L - 1. A run of period q in that range holds at least two neighbouring blocks
    that come again q words on; such distances are extended over the stretch. The stretch of a multiple of q
    that is long enough is that of q, so of equal stretches the smallest distance is the period.
    """
    first, end = _candidates(code, doc, least, repeats)
    place = _ranges(first, end - first)
    part = np.repeat(np.arange(len(first)), end - first)
    # Words as small numbers: their rank among the words of their stretch.
    words, rank = np.unique(part * (int(code.max(initial=0)) + 1) + code[place], return_inverse=True)
    lowest = np.searchsorted(words, np.arange(len(first)) * (int(code.max(initial=0)) + 1))
    x = np.zeros(len(code), np.int64)
    x[place] = rank - lowest[part]
    pad = int(x.max(initial=0)) + 1
    found: dict[tuple[int, int], int] = {}
    # The known run that covers a place and ends last, for leaving out what it implies.
    cover_end, cover_period = np.zeros(len(code), np.int64), np.ones(len(code), np.int64)
    size = 1
    while len(first):
        wide = end - first >= max(least, repeats * size)
        first, end = first[wide], end[wide]
        pairs: set[tuple[int, int]] = set()
        held = [np.zeros(0, np.int64)] * 3
        for seeds in _seeds(x, first, end, size, pad):
            # Rows of two neighbouring blocks may lie in two chunks: the last block's seeds are looked at again.
            owner, start, distance = (np.concatenate([a, b]) for a, b in zip(held, seeds, strict=True))
            if not len(start):
                continue
            last = start == start[-1]
            held = [owner[last], start[last], distance[last]]
            key = start * (2 * size) + distance
            follows = np.isin(key + size * 2 * size, key) & (start + 2 * size + distance <= end[owner])
            implied = (start + 2 * size + distance <= cover_end[start]) & (distance % cover_period[start] == 0)
            good = follows & ~implied
            pairs |= set(zip(owner[good].tolist(), distance[good].tolist(), strict=True))
        for s, d in sorted(pairs, key=lambda p: p[1]):
            a, b = first[s], end[s]
            equal = np.concatenate([[False], x[a : b - d] == x[a + d : b], [False]])
            edges = np.flatnonzero(equal[1:] != equal[:-1])
            for i, j in zip(edges[::2] + a, edges[1::2] + a + d, strict=True):
                if j - i >= max(least, repeats * d):
                    found[i, j] = min(d, found.get((i, j), d))
                    longer = cover_end[i:j] < j
                    cover_end[i:j][longer], cover_period[i:j][longer] = j, found[i, j]
        size *= 2
    runs = sorted((int(i), int(q), int(j - i)) for (i, j), q in found.items())
    return np.array([(i, n, q) for i, q, n in runs], np.int64).reshape(-1, 3)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _worked(texts: list[list[bytes]], least: int, repeats: int) -> list[tuple[int, list[dict], str]]:
    """For each text its number of words, its runs and the text of the words that stay."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base, codes = 0, []
    for words in texts:
        number = dict(zip(dict.fromkeys(words), range(base, base + len(words)), strict=False))
        codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        base += len(number)
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    runs = find_runs(code, doc, least, repeats)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    edges = np.zeros(len(code) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edges[:-1]) > 0
    out = []
    for i, words in enumerate(texts):
        a, b = np.searchsorted(owner, [i, i + 1])
        mine = [{"start": s - begins[i], "length": n, "period": q} for s, n, q in runs[a:b]]
        if a < b:
            words = [w for w, g in zip(words, gone[begins[i] : begins[i + 1]], strict=True) if not g]
        out.append((int(sizes[i]), mine, b" ".join(words).decode()))
    return out


def _finder(least: int, repeats: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, words, begin = batch.column("text"), [], 0, 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                held.append(text.encode().split() if text else [])
                words += len(held[-1])
                if words >= BATCH or i + 1 == batch.num_rows:
                    n, runs, kept = zip(*_worked(held, least, repeats), strict=True)
                    columns = [batch.column("id").slice(begin, len(held)), pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "kept_text"])
                    held, words, begin = [], 0, i + 1

    return find


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, repeats: int = 4
) -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period), kept_text.

    Words lie between blanks, tabs and line ends and are compared as they are; ``start`` is a word number from 0.
    A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``least``
    words and ``repeats`` periods (4 or more); runs come by start, then period, and may overlap. ``kept_text`` is the
    words without those that a run holds after its first q words, joined by one blank.

    Null, empty and blank texts have no words and no runs; texts of any length are worked on whole; each row is a
    document of its own, repeated rows and null ids included. An empty table gives no rows; other columns are
    not looked at. Nothing is shuffled: a text is one value, and a task holds some texts at a time.
    """
    if repeats < 4:
        raise ValueError("runs of fewer than four periods are not looked for")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"
    return rows.mapInArrow(_finder(least, repeats), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, compared as fractions; the first of equal ones, null without any."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best, run):
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, none, better)
