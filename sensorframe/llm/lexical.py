"""Ranked lexical search: posting lists in blocks of similar documents, with summaries that rule blocks out exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.llm.common import partitions
from sensorframe.llm.words import letters_and_digits, mix
from sensorframe.session import stored

# The queries are the small side: their texts go to every task, and more than this is an error.
MOST_BYTES = 16 << 20
# Postings of a block, documents whose posting lists are cut together, and hyperplanes that order documents.
BLOCK = 16
WIDE = 4096
PLANES = 16
# A dense table of documents and terms takes at most so many bytes; so many numbers are gathered at a time.
CELLS = 1 << 26
GATHER = 1 << 20
# Thresholds come from documents that hold an item's rarest terms, as many terms as reach so many documents.
SEEDS = 100
# Longer texts are cut into words slice by slice.
SLICE = 1 << 22


def _table() -> bytes:
    """Bytes of terms with A-Z lowered, all others a blank."""
    inside, lower = letters_and_digits()
    return bytes(int(lower[b]) if inside[b] else 32 for b in range(256))


def terms_of(text: str, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: runs of letters A-Z, digits and characters beyond ASCII."""
    data = text.encode().translate(table)
    begin = 0
    while begin < len(data):
        end = len(data) if begin + SLICE >= len(data) else data.rfind(b" ", begin, begin + SLICE)
        if end <= begin:  # one term is longer than a slice
            end = data.find(b" ", begin + SLICE)
            end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end + 1


@dataclass
class Queries:
    """Distinct terms of all items as numbers, and the sorted terms of each item, one after the other."""

    ids: list
    number: dict[bytes, int]
    first: np.ndarray
    terms: np.ndarray

    def of(self, item: int) -> np.ndarray:
        return self.terms[self.first[item] : self.first[item + 1]]


def read_queries(items: DataFrame, id_col: str, text_col: str) -> Queries:
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of queries; search for at most {MOST_BYTES} at once, in parts")
    table, ids, sets = _table(), [], []
    for row in rows.collect():
        ids.append(row["id"])
        sets.append({t for part in terms_of(row["text"], table) for t in part})
    number = {t: i for i, t in enumerate(sorted(set().union(*sets)))} if sets else {}
    numbers = [sorted(number[t] for t in s) for s in sets]
    first = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int64)
    return Queries(ids, number, first, np.array([n for s in numbers for n in s], np.int64))


# --- documents ---------------------------------------------------------------------------------------

FORWARD = "id long, n long, key long, terms binary, counts binary"


def _reader(shared: Broadcast):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        table, size = _table(), max(len(queries.number), 1)
        # Directions of the planes; a term of many items is frequent and says little about a document.
        bits = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        signs = 1.0 - 2.0 * ((bits[:, None] >> np.arange(PLANES, dtype=np.uint64)) & np.uint64(1))
        signs /= np.log1p(1.0 + np.bincount(queries.terms, minlength=size))[:, None]
        powers = 1 << np.arange(PLANES)[::-1]
        for batch in batches:
            if not batch.num_rows:
                continue
            n, found = np.zeros(batch.num_rows, np.int64), []
            for i, text in enumerate(batch.column("text")):
                parts = []
                for words in terms_of(text.as_py() or "", table):
                    n[i] += len(words)
                    numbers = np.fromiter(map(queries.number.get, words, repeat(-1)), np.int64, len(words))
                    parts.append(numbers[numbers >= 0])
                found.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            pair, count = np.unique(owner * size + np.concatenate(found), return_counts=True)
            owner, term = pair // size, pair % size
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            side = np.zeros((batch.num_rows + 1, PLANES))
            if len(owner):
                here = np.unique(owner)
                side[here] = np.add.reduceat(signs[term] * np.sqrt(count)[:, None], edges[here], axis=0)
            key = (side[:-1] > 0) @ powers
            cut = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            term, count = term.astype(np.int32), count.astype(np.int32)
            columns = [batch.column("id"), pa.array(n), pa.array(key.astype(np.int64))]
            columns += [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (term, count)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "key", "terms", "counts"])

    return read


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the batch, term and count of every posting of a batch of documents."""
    terms, counts = (b"".join(batch.column(c).to_pylist()) for c in ("terms", "counts"))
    sizes = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()], np.int64)
    owner = np.repeat(np.arange(batch.num_rows), sizes)
    return owner, np.frombuffer(terms, np.int32).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.int64)


@dataclass
class Statistics:
    """Documents and terms of the corpus, and a weight for every term of the queries."""

    documents: int
    length: int
    weight: np.ndarray

    def parts(self, n: np.ndarray, owner: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A posting's score before its term's weight: whole numbers throughout."""
        m = 10 + (90 * n * self.documents) // max(self.length, 1)
        return (1_000_000_000 * count) // (1000 * count + 8 * m[owner])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, count = np.unique(_postings(batch)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(count, pa.int64())], ["term", "n"])


def _statistics(forward: DataFrame, queries: Queries) -> tuple[Statistics, np.ndarray]:
    total = forward.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total["documents"], total["length"] or 0
    frequency = np.zeros(max(len(queries.number), 1), np.int64)
    for row in forward.select("terms", "counts").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        frequency[row["term"]] = row["n"]
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency]
    return Statistics(documents, length, np.array(weight, np.int64)), frequency


# --- exact scores ------------------------------------------------------------------------------------


def _scores(dense: np.ndarray, row: np.ndarray, item: np.ndarray, queries: Queries) -> np.ndarray:
    """Scores of pairs of a document (a row of the dense table of term scores) and an item with terms."""
    size = queries.first[item + 1] - queries.first[item]
    out = np.zeros(len(row), np.int64)
    step = max(1, GATHER // max(int(size.max(initial=1)), 1))
    for a in range(0, len(row), step):
        s = size[a : a + step]
        begins = np.concatenate([[0], np.cumsum(s)[:-1]])
        place = np.arange(s.sum()) + np.repeat(queries.first[item[a : a + step]] - begins, s)
        out[a : a + step] = np.add.reduceat(dense[np.repeat(row[a : a + step], s), queries.terms[place]], begins)
    return out


class _Best:
    """The best documents of each item so far: highest score, then smallest id, a null id last."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 4), np.int64)  # item, score, id is null, id

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = ids.fill_null(0).to_numpy()
        rows = np.concatenate([self.rows, np.stack([item, score, null, ids], axis=1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begins = np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[np.arange(len(rows)) - begins < self.k]

    def batch(self) -> pa.RecordBatch:
        item, score, null, ids = self.rows.T
        columns = [pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool))]
        return pa.RecordBatch.from_arrays(columns, ["item", "score", "id"])


_FOUND = "item long, score long, id long"


def _dense(batch: pa.RecordBatch, stats: Statistics, weighted: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of documents and terms, some documents at a time: their first and end, the table, the postings."""
    owner, term, count = _postings(batch)
    part = stats.parts(batch.column("n").to_numpy(), owner, count)
    score = stats.weight[term] * part if weighted else part
    size, kind = len(stats.weight), np.dtype(np.int64 if weighted else np.int32)
    step = min(WIDE, max(1, CELLS // (size * kind.itemsize)))
    for a in range(0, batch.num_rows, step):
        b = min(a + step, batch.num_rows)
        i, j = np.searchsorted(owner, [a, b])
        dense = np.zeros((b - a, size), kind)
        dense[owner[i:j] - a, term[i:j]] = score[i:j]
        yield a, b, dense, owner[i:j] - a, term[i:j]


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# --- thresholds --------------------------------------------------------------------------------------


def _by_term(pairs: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """From pairs (term, item): where the items of each term begin, and the items by term."""
    table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(table[:, 0], np.arange(size + 1)), table[:, 1]


def _expand(first: np.ndarray, values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its values: the places of the keys, and the values."""
    size = first[key + 1] - first[key]
    begins = np.cumsum(size) - size
    place = np.arange(size.sum()) + np.repeat(first[key] - begins, size)
    return np.repeat(np.arange(len(key)), size), values[place]


def _seeder(shared: Broadcast, k: int):
    """Scores of documents that hold an item's rarest terms, and the greatest part of each term."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats, first, items = shared.value
        best, greatest = _Best(k), np.zeros(len(stats.weight), np.int64)
        for batch in batches:
            for a, b, dense, owner, term in _dense(batch, stats, True):
                place, item = _expand(first, items, term)
                pair = np.unique(owner[place] * max(len(queries.ids), 1) + item)
                row, item = np.divmod(pair, max(len(queries.ids), 1))
                best.add(item, _scores(dense, row, item, queries), batch.column("id").slice(a, b - a).take(pa.array(row)))
            owner, term, count = _postings(batch)
            np.maximum.at(greatest, term, stats.parts(batch.column("n").to_numpy(), owner, count))
        yield best.batch()
        held = np.flatnonzero(greatest)
        columns = [pa.array(-1 - held, pa.int64()), pa.array(greatest[held], pa.int64()), pa.nulls(len(held), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "score", "id"])

    return score


def _thresholds(spark, forward: DataFrame, queries: Queries, stats: Statistics, frequency: np.ndarray, k: int):
    """A score that an item's k-th best document reaches for sure, and the greatest score of every term."""
    pairs = []
    for item in range(len(queries.ids)):
        reach = 0
        terms = queries.of(item)
        for t in sorted(terms[frequency[terms] > 0], key=lambda t: frequency[t]):
            pairs.append((int(t), item))
            reach += frequency[t]
            if reach >= max(SEEDS, 10 * k):
                break
    shared = spark.sparkContext.broadcast((queries, stats, *_by_term(pairs, len(stats.weight))))
    found = stored(forward.select("id", "n", "terms", "counts").mapInArrow(_seeder(shared, k), _FOUND))
    greatest = np.zeros(len(stats.weight), np.int64)
    for row in found.where("item < 0").groupBy("item").agg(F.max("score").alias("part")).collect():
        greatest[-1 - row["item"]] = row["part"]
    least = np.ones(len(queries.ids), np.int64)
    for row in _top(found.where("item >= 0"), k).where(F.col("rank") == k).collect():
        least[row["item"]] = max(row["score"], 1)
    return least, greatest * stats.weight


def _opened(queries: Queries, least: np.ndarray, greatest: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (term, item) whose posting lists hold every document that can reach the item's threshold.

    An item's terms with the smallest greatest scores are left out while these sum to less than the threshold.
    """
    out = []
    for item in range(len(queries.ids)):
        terms = queries.of(item)
        terms = terms[np.argsort(greatest[terms], kind="stable")]
        out += [(int(t), item) for t in terms[np.cumsum(greatest[terms]) >= least[item]]]
    return out


# --- blocks ------------------------------------------------------------------------------------------


def _coordinates(queries: Queries, first: np.ndarray, items: np.ndarray, term: int) -> np.ndarray:
    """The terms that an item which opens the term's list can ask for."""
    return np.unique(np.concatenate([queries.of(i) for i in items[first[term] : first[term + 1]]]))


def _blocker(shared: Broadcast):
    """Blocks of the posting lists of documents that lie together, with the greatest part at each coordinate."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats, first, items = shared.value
        wanted = np.diff(first) > 0
        coordinates: dict[int, np.ndarray] = {}
        for batch in batches:
            for a, _, dense, owner, term in _dense(batch, stats, False):
                rows = batch.column("row").to_numpy()
                keep = wanted[term]
                owner, term = owner[keep], term[keep]
                order = np.argsort(term, kind="stable")  # within a list by place: similar documents in turn
                owner, term = owner[order], term[order]
                edges = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else []
                out = [], [], []
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    t = int(term[i])
                    if t not in coordinates:
                        coordinates[t] = _coordinates(queries, first, items, t)
                    starts = np.arange(0, j - i, BLOCK)
                    summary = np.maximum.reduceat(dense[owner[i:j, None], coordinates[t]], starts, axis=0)
                    for s, top in zip(starts, summary, strict=True):
                        out[0].append(t), out[1].append(rows[a + owner[i + s : min(i + s + BLOCK, j)]].tobytes())
                        out[2].append(top.tobytes())
                kinds = pa.int64(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["term", "rows", "summary"])

    return cut


def _prober(shared: Broadcast):
    """Pairs (row, item) of the blocks whose summary lets a document reach the item's threshold."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats, least, first, items = shared.value
        plans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            term = batch.column("term").to_numpy()
            rows, summaries = batch.column("rows").to_pylist(), batch.column("summary").to_pylist()
            out_row, out_item = [], []
            order = np.argsort(term, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(term[order]) != 0, [True]])) if len(term) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                t = int(term[order[i]])
                if t not in plans:
                    coordinates, mine = _coordinates(queries, first, items, t), items[first[t] : first[t + 1]]
                    member = np.stack([np.isin(coordinates, queries.of(q)) for q in mine], axis=1)
                    plans[t] = stats.weight[coordinates], member.astype(np.int64), mine
                weight, member, mine = plans[t]
                at = order[i:j]
                top = np.frombuffer(b"".join(summaries[x] for x in at), np.int32).reshape(len(at), -1)
                block, item = np.nonzero((top * weight) @ member >= least[mine])
                for x, q in zip(at[block], mine[item], strict=True):
                    here = np.frombuffer(rows[x], np.int64)
                    out_row.append(here), out_item.append(np.full(len(here), q, np.int64))
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out_row, out_item)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "item"])

    return probe


def _scorer(shared: Broadcast, k: int):
    """The best documents of each item in a task, by exact scores of the pairs that were left."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats, least = shared.value
        best = _Best(k)
        for batch in batches:
            lists = batch.column("items").to_pylist()
            for a, b, dense, _, _ in _dense(batch, stats, True):
                row = np.repeat(np.arange(b - a), [len(x) for x in lists[a:b]])
                item = np.array([q for x in lists[a:b] for q in x], np.int64)
                value = _scores(dense, row, item, queries)
                good = value >= least[item]
                best.add(item[good], value[good], batch.column("id").slice(a, b - a).take(pa.array(row[good])))
        yield best.batch()

    return score


def ranked_search(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Rows (item_id, rank, id, score): each item's ``k`` documents with the highest scores above 0.

    Terms are runs of letters A-Z, digits and characters beyond ASCII, A-Z lowered. A document's score sums, over an
    item's different terms, the term's weight floor(1000 ln((2 N + 2) / (2 df + 1))) times
    10^9 tf div (1000 tf + 8 m), with m = 10 + 90 n N div L, in whole numbers; N counts documents with a term, L all
    their terms, n those of a document. Equal scores go by id, a null id last. Ids are whole numbers; repeated rows and
    ids each have their rank. Null and empty texts have no terms and count nowhere; texts of any length are read whole;
    an item without terms, and an empty table on either side, gives no rows; other columns are not looked at.

    One scan of the texts writes, per document, counts of the queries' terms, in the order of the signs of 16 random
    projections, so that similar documents lie together. Documents with an item's rarest terms are scored for a
    threshold. The posting lists that can still hold a better document (terms whose greatest scores sum to less are
    left out) are cut into blocks of up to 16 similar documents, stored with the greatest part at every
    coordinate that the items of the list ask for. A block is skipped for an item only if these coordinates sum to less
    than the threshold; the documents of the others are scored exactly. Nothing is estimated. Every
    step is a map over documents or blocks; each task hands on at most ``k`` documents an item. The queries are
    broadcast, their size checked.
    """
    queries = read_queries(items, item_id_col, item_text_col)
    kind = items.schema[item_id_col].dataType.simpleString()
    if not queries.number:
        return spark.createDataFrame([], f"item_id {kind}, rank int, id long, score long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = rows.mapInArrow(_reader(spark.sparkContext.broadcast(queries)), FORWARD).where("n > 0")
    read = read.withColumn("salt", F.xxhash64("id", "n")).repartitionByRange(partitions(spark), "key", "n", "salt")
    forward = stored(read.sortWithinPartitions("key", "n", "salt").drop("key", "salt").withColumn("row", F.monotonically_increasing_id()))
    stats, frequency = _statistics(forward, queries)
    least, greatest = _thresholds(spark, forward, queries, stats, frequency, k)
    first, asking = _by_term(_opened(queries, least, greatest), len(stats.weight))

    cutter = _blocker(spark.sparkContext.broadcast((queries, stats, first, asking)))
    blocks = stored(forward.select("row", "n", "terms", "counts").mapInArrow(cutter, "term long, rows binary, summary binary"))
    prober = _prober(spark.sparkContext.broadcast((queries, stats, least, first, asking)))
    pairs = blocks.mapInArrow(prober, "row long, item long").groupBy("row").agg(F.collect_set("item").alias("items"))
    left = forward.join(pairs.hint("merge"), "row").select("id", "n", "terms", "counts", "items")
    found = left.mapInArrow(_scorer(spark.sparkContext.broadcast((queries, stats, least)), k), _FOUND)
    # The queries' ids back to their rows: one small table of known size.
    names = spark.createDataFrame([(i, x) for i, x in enumerate(queries.ids)], f"item long, item_id {kind}")
    return _top(found, k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "id", "score")
