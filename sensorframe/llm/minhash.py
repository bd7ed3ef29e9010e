"""Near duplicates: an LSH forest of MinHash signatures finds clusters, full shingle sets confirm the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.llm.common import bitmap, marked, numbered_rows, partitions, slot_of, utf8
from sensorframe.llm.components import connected_components
from sensorframe.llm.words import blank_separated, mix, word_hashes
from sensorframe.session import stored

TREES = 32
# Values of a signature order that make up one level of its tree.
STEP = 4
LEVELS = 4
# A region with more documents is looked at one level deeper.
REGION = 2_000
# Two one-bit sketches of 64 values each must agree in so many of 128 places: less than 10^-7 of the pairs at
# similarity 0.8 (114.9 expected, deviation 3.4) fall below.
AGREE = 95
# Documents of a cluster that are compared with each other, or with as many others, in one task.
BLOCK = 1_024
BITMAP_BITS = 25


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each text; a shorter text is one shingle."""
    words, first = word_hashes(data, offsets, blank_separated())
    joined = words.copy()
    for k in range(1, size):
        joined[: len(words) - k] = mix(joined[: len(words) - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TREES * STEP
        seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))[:, None]
        odd = mix(seeds + np.uint64(77)) | np.uint64(1)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            counts, digests, keys, sketches = [], [], [], []
            for s in shingle_sets(data, offsets, size):
                counts.append(len(s))
                if not len(s):
                    digests.append(None), keys.append(None), sketches.append((None, None))
                    continue
                low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), 2048):
                    np.minimum(low, ((s[None, i : i + 2048] ^ seeds) * odd).min(axis=1), out=low)
                # Equal sets: two sums over well mixed hashes.
                digests.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5)).sum()], np.uint64).tobytes())
                low = mix(low)
                key = np.zeros(TREES, np.uint64)
                for k in range(STEP):
                    key = mix(key * np.uint64(31) + low[k::STEP])
                keys.append((key + np.arange(TREES, dtype=np.uint64)).astype(np.int64))
                one = (low & np.uint64(1)).astype(np.uint64)
                sketches.append([int((one[j : j + 64] * bits).sum().astype(np.int64)) for j in (0, 64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array([s[0] for s in sketches], pa.int64()),
                    pa.array([s[1] for s in sketches], pa.int64()),
                ],
                ["id", "n_shingles", "digest", "keys", "s1", "s2"],
            )

    return sign


def _stars(alike) -> list[tuple[int, int]]:
    """Each connected group as links from its first member; ``alike(i, others)`` says which of the others are next to i."""
    links, rest = [], alike.rest
    while len(rest):
        first, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = alike(queue.pop(), rest)
            links += [(first, j) for j in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return links


class _Sketches:
    def __init__(self, s1: np.ndarray, s2: np.ndarray):
        self.s1, self.s2, self.rest = s1, s2, np.arange(len(s1))

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(self.s1[i] ^ self.s1[others]) + np.bitwise_count(self.s2[i] ^ self.s2[others])
        return apart <= 128 - AGREE


class _Matrix:
    def __init__(self, linked: np.ndarray):
        self.linked, self.rest = linked, np.arange(len(linked))

    def __call__(self, i: int, others: np.ndarray) -> np.ndarray:
        return self.linked[i, others]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows of equal keys, from batches of a partition sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last, start = [batch.column(k)[-1] for k in keys], [held[0].column(k)[0] for k in keys]
        if last == start:
            continue
        table = pa.Table.from_batches(held)
        changed = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            changed |= x[1:] != x[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1)]
        yield table, edges
        held = table.slice(edges[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, [0, table.num_rows]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that span the groups of documents with like sketches in each region."""
    for table, edges in _runs(batches, ["region"]):
        docs, s1, s2 = (table.column(c).to_numpy() for c in ("rep", "s1", "s2"))
        s1, s2 = s1.astype(np.uint64), s2.astype(np.uint64)
        u, v = [], []
        edges = np.array(edges)
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        like = np.bitwise_count(s1[two] ^ s1[two + 1]) + np.bitwise_count(s2[two] ^ s2[two + 1]) <= 128 - AGREE
        u += list(docs[two[like]])
        v += list(docs[two[like] + 1])
        for a, b in zip(edges[:-1][size > 2], edges[1:][size > 2], strict=True):
            for i, j in _stars(_Sketches(s1[a:b], s2[a:b])):
                u.append(docs[a + i]), v.append(docs[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _setter(size: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            sets = [s.tobytes() for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return collect


def _confirmer(similarity: int):
    def links_of(sets: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(s) for s in sets])
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return [(0, 1)] if 100 * both >= similarity * (size.sum() - both) else []
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        values, place, n = np.unique(every, return_inverse=True, return_counts=True)
        both = np.zeros((len(sets), len(sets)), np.float32)
        shared = np.cumsum(n > 1) - 1
        keep = n[place] > 1
        column, owner = shared[place[keep]], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        # Shingles in strips, so the matrix of documents and shingles stays small.
        common = int((n > 1).sum())
        width = max(1, min(common, (1 << 22) // len(sets)))
        for a in range(0, common, width):
            i, j = np.searchsorted(column, [a, a + width])
            strip = np.zeros((len(sets), width), np.float32)
            strip[owner[i:j], column[i:j] - a] = 1
            both += strip @ strip.T
        both = both.astype(np.int64)
        linked = 100 * both >= similarity * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        return _stars(_Matrix(linked))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that span the groups of a task's documents with confirmed similarity."""
        for table, edges in _runs(batches, ["cluster", "low", "high"]):
            docs = table.column("rep").to_numpy()
            blobs = table.column("shingles")
            u, v = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in blobs.slice(a, b - a)]
                    for i, j in links_of(sets):
                        u.append(docs[a + i]), v.append(docs[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return confirm


def _regions(one: DataFrame) -> DataFrame:
    """Rows (region, rep, s1, s2) of all regions with two documents or more.

    A region is the documents with one prefix of a signature order. It goes one level deeper while it has more
    than ``REGION`` documents. At the last level it is dealt into blocks that all hold its first document.
    """
    out, rest = None, one.select("rep", F.posexplode("keys").alias("tree", "region"))
    for level in range(LEVELS):
        counts = rest.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rest = stored(rest.join(stored(counts), "region"))
        small = rest.where(F.col("n") <= REGION).select("region", "rep")
        out = small if out is None else out.unionByName(small)
        rest = rest.where(F.col("n") > REGION)
        if rest.isEmpty():
            break
        if level < LEVELS - 1:
            longer = F.xxhash64("region", F.get("keys", (F.col("tree") + level + 1) % TREES))
            rest = rest.join(one.select("rep", "keys"), "rep").select("rep", "tree", longer.alias("region"))
        else:
            blocks = F.ceil(F.col("n") / REGION)
            own = F.pmod(F.xxhash64("rep"), blocks)
            pairs = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            key = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"))
            out = out.unionByName(pairs.select(key.alias("region"), "rep"))
    return out.join(one.select("rep", "s1", "s2"), "rep")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words lie between blanks, tabs and line ends, A-Z in lower case. Documents whose sets of ``size``-word
    shingles have 100 * intersection >= ``similarity`` * union are linked; a text with fewer words is one
    shingle, and a null, empty or blank text has none and is linked with nothing. ``component_id`` is the
    smallest id that can be reached over links. Ids are whole numbers; repeated rows and ids each get a row, and a row
    with a null id is its own component, null. An empty table gives no rows; other columns are not looked at.

    Equal sets are one class from the start. The classes' signatures of 128 values are read in 32 orders; in
    each, classes with a common prefix of four values are a region, and too large a region is cut by longer
    prefixes. A pair at 0.8 has no such prefix in any order with probability 5 * 10^-8. Where all its regions are so
    large that they go deeper the pair alone would be missed more often (by a transfer matrix over the orders 1 % at eight
    values, 22 % at twelve, 56 % at sixteen), but there its neighbours in the crowd chain it. Like pairs
    of a region, by 128-bit sketches, chain the classes to clusters. In a cluster the full sets are compared
    exactly, blocks of documents against blocks, and confirmed links give the components. Links leave a task
    as stars that join the same documents: as many as documents, not as pairs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = rows.mapInArrow(
        _signer(size), "id long, n_shingles long, digest binary, keys array<long>, s1 long, s2 long"
    )
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()))
    named = signed.where("id is not null and digest is not null")
    classes = stored(named.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("row", "id").alias("row")))
    one = stored(named.join(classes.select("rep", "row"), "row").select("rep", "keys", "s1", "s2"))
    n = partitions(docs.sparkSession)
    regions = _regions(one).repartition(n, "region").sortWithinPartitions("region", "rep")
    clusters = stored(connected_components(regions.mapInArrow(_neighbours, "u long, v long"))).withColumnRenamed("node", "rep")

    # Documents of a cluster are numbered to deal them into blocks; a large cluster is numbered part by part.
    clusters = clusters.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(64)))
    parts = clusters.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("component").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("component", "part", before.alias("before"), F.sum("n").over(W.partitionBy("component")).alias("total"))
    number = F.row_number().over(W.partitionBy("component", "part").orderBy("rep")) - 1
    clusters = stored(
        clusters.withColumn("number", number)
        .join(parts, ["component", "part"])
        .select(
            "rep",
            F.col("component").alias("cluster"),
            F.floor((F.col("before") + F.col("number")) / BLOCK).alias("block"),
            F.ceil(F.col("total") / BLOCK).alias("blocks"),
        )
    )

    # The sets of these documents alone, found in a second scan by a bitmap of bounded size.
    wanted = bitmap(clusters.select(slot_of(BITMAP_BITS, "rep").alias("slot")))
    texts = marked(rows.where("id is not null").withColumnRenamed("id", "rep"), slot_of(BITMAP_BITS, "rep"), wanted, "hit")
    texts = texts.where("hit").select("rep", "text")
    sets = texts.mapInArrow(_setter(size), "rep long, shingles binary").where(F.length("shingles") > 0)
    dealt = sets.join(clusters, "rep").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "shingles")
    keys = ["cluster", "low", "high"]
    dealt = dealt.repartition(n, *keys).sortWithinPartitions(*keys, "rep")
    links = dealt.mapInArrow(_confirmer(similarity), "u long, v long")
    joined = stored(connected_components(links))

    classes = classes.join(joined, F.col("rep") == F.col("node"), "left")
    classes = classes.select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component"))
    known = (F.col("digest") == F.col("d")) & F.col("id").isNotNull()
    return signed.join(classes, known, "left").select(
        "id",
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: int = 80) -> DataFrame:
    """One document of each group of near duplicates, and all others, with all their columns.

    Groups are those of ``near_dedup`` over rows, not ids: of a group the row with the smallest id stays (a null id
    counts last, equal ids by their place in the stored rows), and a row that shares its id with a dropped one is
    not touched. Null, empty and blank texts all stay. Texts of any length are read whole; columns of any name
    pass through; an empty table stays empty.
    """
    rows, row = numbered_rows(docs)
    groups = near_dedup(rows.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text")), size=size, similarity=similarity)
    groups = stored(groups.select(F.col("id").alias("r"), F.col("component_id").alias("group")))
    several = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    members = groups.join(several, "group")
    order = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    members = stored(members.join(rows.select(F.col(row).alias("r"), order.alias("order")), "r"))
    first = members.groupBy("group").agg(F.min("order").alias("first"))
    gone = members.join(first, "group").where("order.row != first.row").select(F.col("r").alias(row))
    return rows.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)  # the same join at every size
