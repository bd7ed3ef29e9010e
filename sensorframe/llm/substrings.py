"""Repeated substrings across documents: bounded interval expansion over a Burrows-Wheeler order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.common import bitmap, marked, partitions, slot_of, utf8
from sensorframe.llm.minhash import _runs
from sensorframe.llm.words import SLICE, _tables, mix
from sensorframe.session import stored

LENGTH = 50
# A window of LENGTH bytes is filed under the smallest hash of the strings of GRAM bytes in it.
GRAM = 24
# Windows that follow one another under the same hash travel together, at most so many.
STRETCH = 64
# Bits of the map of hashes that occur in several documents. With more hashes than bits it lets more
# windows through, never fewer.
MAP_BITS = 27
# Parts of the map; each is made by one task.
MAP_PARTS = 1_024
HASH_BITS = 48
# Windows under a hash of more documents are spread by their whole content.
HOT = 4_096
DOC_BITS = 25
# Stretches whose windows are expanded at once, as far as these make whole buckets.
TOGETHER = 20_000


def _running(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any part of the data is a difference."""
    total = np.zeros(len(data) + 1, np.uint64)
    part = data.astype(np.uint64)
    part += np.uint64(1)
    part *= _tables()[0][: len(data)]
    np.cumsum(part, out=total[1:])
    return total


def _hashes(total: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    out = total[GRAM:] - total[:-GRAM]
    out *= _tables()[1][: len(out)]
    # One multiplication spreads the low bits enough to compare by the high ones.
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out >>= np.uint64(64 - HASH_BITS)
    return out


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place on."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window, number of windows, hash, key) of all stretches, slice by slice; texts of any length.

    The key is a 64-bit hash of the bytes that the stretch covers.
    """
    full = np.flatnonzero(np.diff(offsets) >= LENGTH)
    begin = 0
    while begin < len(full):
        # Short texts together, a long one in slices that overlap by a window less one byte.
        end = max(begin + 1, int(np.searchsorted(offsets[full + 1], offsets[full[begin]] + SLICE, side="right")))
        rows = full[begin:end]
        low, high = int(offsets[rows[0]]), int(offsets[rows[-1] + 1])
        for at in range(low, max(low + 1, high - LENGTH + 1), SLICE - LENGTH):
            part = data[at : min(high, at + SLICE - 1)]
            if len(part) < LENGTH:
                break
            total = _running(part)
            least = _window_minimum(_hashes(total), LENGTH - GRAM + 1)[: SLICE - LENGTH]
            place = np.arange(at, at + len(least))
            row = np.repeat(rows, np.diff(np.r_[np.searchsorted(place, offsets[rows]), len(place)])) if len(rows) > 1 else np.full(len(place), rows[0])
            inside = place + LENGTH <= offsets[row + 1]
            inside &= place >= offsets[row]
            head = np.ones(len(least), bool)
            head[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
            first = np.flatnonzero(head)
            n = np.diff(np.r_[first, len(least)])
            first, n = first[inside[first]], n[inside[first]]
            long = n > STRETCH
            if long.any():
                cuts = -(-n // STRETCH)
                step = (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * STRETCH
                whole = np.repeat(n, cuts)
                first, n = np.repeat(first, cuts) + step, np.minimum(STRETCH, whole - step)
            # Minima are small numbers; mixed once more they fill the map evenly.
            value, cover = mix(least[first]) >> np.uint64(64 - HASH_BITS), (n + LENGTH - 1).astype(np.uint64)
            key = (total[first + n + LENGTH - 1] - total[first]) * _tables()[1][first]
            yield row[first], place[first] - offsets[row[first]], n, value, mix(mix(key + cover) ^ value)
        begin = end


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of the map the hashes of this task, six bytes each, and in how many rows they occur, up to 255."""
    held, size = [], 0

    def flush():
        values, n = np.unique(np.concatenate(held), return_counts=True)
        part = (values >> np.uint64(HASH_BITS - 10)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(MAP_PARTS + 1))
        six = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        n = np.minimum(n, 255).astype(np.uint8)
        some = np.flatnonzero(np.diff(edges))
        hashes = [six[edges[p] : edges[p + 1]].tobytes() for p in some]
        counts = [n[edges[p] : edges[p + 1]].tobytes() for p in some]
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["part", "hashes", "counts"])

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for row, _, _, value, _ in _stretches(data, offsets):
            # Once per row: the 48 bits of the hash with 16 bits of the row in front.
            once = np.unique(value | ((row.astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(HASH_BITS)))
            held.append(once & np.uint64((1 << HASH_BITS) - 1))
            size += len(held[-1])
        if size > 4_000_000:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _mapper(bits: int):
    width = (1 << bits) // MAP_PARTS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two bitmaps for each part: hashes of several rows, and of more than HOT rows."""
        for table, edges in _runs(batches, ["part"]):
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                six = np.frombuffer(b"".join(table.column("hashes").slice(a, b - a).to_pylist()), np.uint8).reshape(-1, 6)
                n = np.frombuffer(b"".join(table.column("counts").slice(a, b - a).to_pylist()), np.uint8)
                values = np.zeros((len(six), 8), np.uint8)
                values[:, :6] = six
                values = values.view("<u8")[:, 0]
                order = np.argsort(values, kind="stable")
                values, n = values[order], n[order].astype(np.int64)
                head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
                total = np.add.reduceat(n, head)
                slot = ((values[head] >> np.uint64(HASH_BITS - bits)) % np.uint64(width)).astype(np.int64)
                row = [table.column("part")[a].as_py()]
                for most in (1, HOT):
                    on = np.zeros(width, bool)
                    on[slot[total > most]] = True
                    row.append(np.packbits(on).tobytes())
                out.append(row)
            part, shared, hot = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(shared, pa.binary()), pa.array(hot, pa.binary())], ["part", "shared", "hot"])

    return build


def _is_set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values that lie one behind the other in ``data``."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _emitter(maps, bits: int, buckets: int, only_hot: bool = False):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches under a hash of several rows, equal ones of a batch in one row.

        The row holds all their places, but for stretches under a very frequent hash; ``only_hot`` gives the keys
        and places of these.
        """
        shared, hot = maps.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            held = []
            for row, first, n, value, key in _stretches(data, offsets):
                slot = (value >> np.uint64(HASH_BITS - bits)).astype(np.int64)
                keep = np.flatnonzero(_is_set(shared, slot))
                row, first, n, value, key = row[keep], first[keep], n[keep], value[keep], key[keep]
                spread = _is_set(hot, slot[keep])
                if spread.any():  # window by window, filed under its content
                    many = np.where(spread, n, 1)
                    one = np.repeat(np.arange(len(n)), many)
                    step = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
                    row, value, key, spread = row[one], value[one], key[one], spread[one]
                    first, n = first[one] + step, np.where(spread, 1, n[one])
                    at = np.flatnonzero(spread)
                    window = (offsets[row[at]] + first[at])[:, None] + np.arange(LENGTH)
                    total = np.zeros(len(at), np.uint64)
                    for column in data[window].T:
                        total = total * np.uint64(0x100000001B3) + column + np.uint64(1)
                    key[at] = value[at] = mix(total)
                if only_hot:
                    row, first, n, value, key, spread = (x[spread] for x in (row, first, n, value, key, spread))
                held.append((row, first, n, value, key, spread))
            if not held:
                continue
            row, first, n, value, key, spread = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids[row], key))
            row, first, n, value, key, spread = (x[order] for x in (row, first, n, value, key, spread))
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            places = np.column_stack([ids[row], first]).astype("<i8")
            for i in range(0, len(head), 20_000):
                at = head[i : i + 20_000]
                edges = np.r_[at, head[i + 20_000] if i + 20_000 < len(head) else len(key)]
                size = n[at] + LENGTH - 1
                begin = offsets[row[at]] + first[at]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                count = np.diff(edges)
                if only_hot:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[at].astype(np.int64)), _binary(places[edges[0] : edges[-1]], count * 16)], ["key", "places"]
                    )
                    continue
                own = places[edges[0] : edges[-1]][~np.repeat(spread[at], count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        # What the places tell already is left null, which costs next to nothing in a shuffle.
                        pa.array(key[at].astype(np.int64), mask=~spread[at]),
                        pa.array((mix(value[at]) % np.uint64(buckets)).astype(np.int64)),
                        _binary(data[np.repeat(begin, size) + inside], size),
                        pa.array(places[at, 0], mask=~spread[at]),
                        _binary(own, np.where(spread[at], 0, count) * 16),
                    ],
                    ["key", "bucket", "window_text", "doc", "places"],
                )

    return emit


def expand(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``length`` bytes that end before ``ends``, in sorted order, and the interval of each.

    Breadth-first backward extension from the empty string: one interval holds all windows. At each level the
    bytes in front of the sorted suffixes are the Burrows-Wheeler column; sorting by it, stably, is the step to
    the suffixes one byte longer (LF mapping). An interval of the longer string begins where the byte changes
    or where the two suffixes were in different intervals, that is, where the common prefix ends. After
    ``length`` levels an interval is a set of equal windows; longer prefixes are never looked at.
    """
    order, interval = np.arange(len(ends)), np.zeros(len(ends), np.int32)
    for level in range(1, length + 1):
        column = text[ends[order] - level]
        step = np.argsort(column, kind="stable")
        order, column, interval = order[step], column[step], interval[step]
        begins = np.ones(len(order), bool)
        begins[1:] = (column[1:] != column[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(begins, dtype=np.int32) - 1
    return order, interval


def _ranges(places: np.ndarray, n_places: np.ndarray, spans: np.ndarray, n_spans: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Documents, and for each the ranges (first byte, end) that some stretch at some place marks as repeated."""
    row = np.repeat(np.arange(len(n_places)), n_places)
    first = np.cumsum(n_spans) - n_spans
    many = n_spans[row]
    place = np.repeat(np.arange(len(places)), many)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
    span = spans[first[row[place]] + nth]
    doc, start = places[place, 0], places[place, 1] + span[:, 0]
    hit = span[:, 2] < doc
    doc, start, end = doc[hit], start[hit], (start + span[:, 1] + LENGTH - 1)[hit]
    order = np.lexsort((start, doc))
    doc, ranges = doc[order], np.column_stack([start, end])[order].astype("<i8")
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    edges = np.r_[head, len(doc)]
    return doc[head], [ranges[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _whole(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    return np.frombuffer(data.tobytes(), "<i8").reshape(-1, width), np.diff(offsets) // (8 * width)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the windows of a stretch the smallest document they start in, as runs (first, number, doc).

    Rows with places become (doc, ranges); the others, one for each key, (key, spans).
    """
    for table, edges in _runs(batches, ["bucket"]):
        keys, docs = (table.column(c).combine_chunks().fill_null(0).to_numpy() for c in ("key", "doc"))
        data, offsets = utf8(table.column("window_text"))
        places, n_places = _whole(table.column("places"), 2)
        upto = np.r_[0, np.cumsum(n_places)]
        some = np.flatnonzero(n_places)
        docs = docs.copy()
        docs[some] = places[upto[some], 0]  # the places of a row are sorted
        # Buckets are taken together up to a fair size; equal windows are never in different ones.
        bounds, last = np.array(edges), 0
        while last < bounds[-1]:
            a, last = last, int(bounds[min(len(bounds) - 1, np.searchsorted(bounds, last + TOGETHER))])
            b = last
            n = np.diff(offsets[a : b + 1]) - LENGTH + 1
            base = offsets[a]
            owner = np.repeat(np.arange(b - a), n)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            order, interval = expand(data[base : offsets[b]], offsets[a:b][owner] - base + nth + LENGTH, LENGTH)
            head = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
            least = np.empty(len(owner), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(docs[a:b][owner][order], head), np.diff(np.r_[head, len(owner)]))
            at = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
            spans = np.column_stack([nth[at], np.diff(np.r_[at, len(owner)]), least[at]]).astype("<i8")
            rows = np.searchsorted(owner[at], np.arange(b - a + 1))
            doc, ranges = _ranges(places[upto[a] : upto[b]], n_places[a:b], spans, np.diff(rows))
            bare = np.flatnonzero(n_places[a:b] == 0)
            key, one = np.unique(keys[a:b][bare], return_index=True)
            verdicts = [spans[rows[i] : rows[i + 1]].tobytes() for i in bare[one]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*doc.tolist(), *[None] * len(key)], pa.int64()),
                    pa.array([*ranges, *[None] * len(key)], pa.binary()),
                    pa.array([*[None] * len(doc), *key.tolist()], pa.int64()),
                    pa.array([*[None] * len(doc), *verdicts], pa.binary()),
                ],
                ["doc", "ranges", "key", "spans"],
            )


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, ranges) from keys with places and spans."""
    for batch in batches:
        doc, ranges = _ranges(*_whole(batch.column("places"), 2), *_whole(batch.column("spans"), 3))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ranges, pa.binary())], ["doc", "ranges"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept, digest = [], [], [], []
        for text, blobs in zip(batch.column("text").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
            text = text.encode() if text else b""
            ranges = np.frombuffer(b"".join(blobs or []), "<i8").reshape(-1, 2)
            ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
            runs: list[list[int]] = []
            for a, b in ranges.tolist():
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            edges = [0, *(x for r in runs for x in r), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            removed.append(len(text) - len(rest)), spans.append([{"start": a, "end": b} for a, b in runs])
            kept.append(rest), digest.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()),
                pa.array(digest, pa.string()),
            ],
            ["id", "n_bytes", "n_removed", "removed", "kept", "kept_sha256"],
        )


def repeated_substrings(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAP_BITS
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, removed (runs of bytes), kept (bytes), kept_sha256.

    Texts are UTF-8 bytes, null counts as empty. Every byte is removed that is covered by a string of 50 bytes
    which also starts in a document with a smaller id; the input alone decides. Ids are whole numbers; rows of
    equal id do not take from each other; a row with a null id keeps everything and takes nothing. Repeated
    rows each get a row; an empty table gives no rows; other columns are not looked at.

    A window is filed under the smallest 24-byte hash in it, so equal windows meet whatever surrounds them. A first
    scan finds the hashes of several documents; they set a bitmap of ``1 << bits`` bits. A second scan sends
    the windows under such hashes, in stretches, to a task per bucket, where intervals of equal windows are
    expanded to 50 bytes; equal stretches of a batch are sent once. Windows under a very frequent hash are
    spread by their content and leave their places behind; these find the verdict by the window's key.
    """
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = rows.where(f"id is not null and octet_length(text) >= {LENGTH}")
    counts = texts.select("text").mapInArrow(_counter, "part long, hashes binary, counts binary")
    counts = counts.repartition(n, "part").sortWithinPartitions("part")
    parts = counts.mapInArrow(_mapper(bits), "part long, shared binary, hot binary").toArrow()
    maps = np.zeros((2, (1 << bits) // 8), np.uint8)  # bounded by ``bits``
    width = (1 << bits) // MAP_PARTS // 8
    for p, *found in zip(*(parts.column(c).to_pylist() for c in ("part", "shared", "hot")), strict=True):
        for i in (0, 1):
            maps[i, p * width : (p + 1) * width] = np.frombuffer(found[i], np.uint8)
    shared = spark.sparkContext.broadcast(tuple(maps))

    schema = "key long, bucket long, window_text binary, doc long, places binary"
    stretches = texts.mapInArrow(_emitter(shared, bits, 64 * n), schema)
    sorted_ = stretches.repartition(n, "bucket").sortWithinPartitions("bucket")
    decided = stored(sorted_.mapInArrow(_decide, "doc long, ranges binary, key long, spans binary"))
    marks = decided.where("doc is not null").select("doc", "ranges")
    if maps[1].any():
        # Places of very frequent windows: a row per batch of texts and window, so a join can split them.
        verdicts = decided.where("key is not null").select("key", "spans")
        hot = texts.mapInArrow(_emitter(shared, bits, 64 * n, only_hot=True), "key long, places binary")
        marks = marks.unionByName(hot.join(verdicts, "key").select("places", "spans").mapInArrow(_mark, "doc long, ranges binary"))
    marks = stored(marks.groupBy("doc").agg(F.collect_list("ranges").alias("blobs")))

    wanted = bitmap(marks.select(slot_of(DOC_BITS, "doc").alias("slot")))
    rows = marked(rows, slot_of(DOC_BITS, "id"), wanted, "hit")
    whole = rows.where("not hit or id is null").withColumn("bytes", F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    whole = whole.select(
        "id",
        F.octet_length("bytes").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"),
        F.col("bytes").alias("kept"),
        F.sha2("bytes", 256).alias("kept_sha256"),
    )
    cut = rows.where("hit and id is not null").join(marks.hint("merge"), F.col("id") == F.col("doc"), "left").select("id", "text", "blobs")
    cut = cut.mapInArrow(
        _cut, "id long, n_bytes long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string"
    )
    return whole.unionByName(cut)
