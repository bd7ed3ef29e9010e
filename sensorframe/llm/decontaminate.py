"""Benchmark decontamination by latent semantic retrieval, confirmed word by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.common import Lookup, numbered_rows, utf8
from sensorframe.llm.words import letters_and_digits, word_hashes
from sensorframe.session import stored

STRIDE = 16  # words; a passage is two strides
RANK = 64
COSINE = 0.45
SUBSEQUENCE = 0.7
ANSWER = 0.5
# The benchmark is the small side and is sent to every task; a larger one is an error, to be given in parts.
MOST_TERMS = 2_000_000
# Terms in a larger share of the strides are not counted when candidates are ruled out; that only rules out fewer.
COMMON = 0.05
# Strides a task looks at in one step, and cells of its table of strides and items; larger benchmarks are met in blocks.
STEP = 5_000
CELLS = 1 << 21


@dataclass
class Benchmark:
    ids: list  # of the items
    words: list[np.ndarray]  # term numbers of each item in order
    terms: np.ndarray  # hashes, sorted


def read_benchmark(items: DataFrame, id_col: str = "item_id", text_col: str = "text", at_most: int = MOST_TERMS) -> Benchmark:
    """The items as sequences of terms. Items that are null or have no word can match nothing and are left out."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > 8 * at_most:
        raise ValueError(f"the benchmark has {size} bytes; give it in parts of at most {8 * at_most}")
    table = rows.orderBy("id", "text").toArrow()
    data, offsets = utf8(table.column("text"))
    hashes, first = word_hashes(data, offsets, letters_and_digits(), latin=True)
    terms, number = np.unique(hashes, return_inverse=True)
    spans = [(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
    kept = [i for i, (a, b) in enumerate(spans) if b > a]
    ids = table.column("id").to_pylist()
    return Benchmark([ids[i] for i in kept], [number[spans[i][0] : spans[i][1]].astype(np.int32) for i in kept], terms)


def _numberer(benchmark):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(benchmark.value.terms)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            hashes, first = word_hashes(data, offsets, letters_and_digits(), latin=True)
            terms = find(hashes).astype("<i4").tobytes()
            words = [terms[4 * a : 4 * b] for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.binary())], ["id", "words"])

    return number


def _passages(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All terms of a batch, the stride of each word, and the first stride of each document (one more at the end)."""
    data, offsets = utf8(batch.column("words"))
    words = np.frombuffer(data, "<i4")
    n = np.diff(offsets) // 4
    strides = np.r_[0, np.cumsum(-(-n // STRIDE))]
    place = np.arange(len(words)) - np.repeat(offsets[:-1] // 4, n)
    return words, np.repeat(strides[:-1], n) + place // STRIDE, strides


def _frequencies(n_terms: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            words, stride, strides = _passages(batch)
            known = words >= 0
            pairs = np.sort(stride[known] * n_terms + words[known])
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
            seen += np.bincount(pairs % n_terms, minlength=n_terms)
            total += int(strides[-1])
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[total, seen[at]])], ["term", "n"])

    return count


def _sums(place: np.ndarray, values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """For each place the sum of the columns of ``values`` at its indices; dimension by dimension, as these fit a cache."""
    out = np.empty((len(values), n))
    for k, value in enumerate(values):
        out[k] = np.bincount(place, weights=value[index], minlength=n)
    return out


def _gram(weighted, n_terms: int):
    """Partial sums of AᵀAΩ, a row per term: A has the passages of this task as weighted term counts."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, omega = weighted.value
        factors = np.ascontiguousarray((weight[:, None] * omega).T)
        total = np.zeros((omega.shape[1], n_terms))
        for batch in batches:
            words, stride, _ = _passages(batch)
            keep = np.flatnonzero(words >= 0)
            held = stride[keep]
            for i in range(0, int(held[-1]) + 1 if len(held) else 0, STEP):
                a, b = np.searchsorted(held, [i, i + STEP])
                w, s = words[keep[a:b]], held[a:b] - i
                total += _sums(w, _sums(s, factors, w, STEP), s, n_terms)
        total = total.T
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        for i in range(0, len(at), 5_000):
            part = total[at[i : i + 5_000]] * weight[at[i : i + 5_000], None]
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 5_000]), pa.array(list(part), pa.list_(pa.float64()))], ["term", "row"])

    return multiply


def latent_space(spark: SparkSession, numbered: DataFrame, benchmark: Benchmark, rank: int = RANK, seed: int = 5):
    """Weights (TF-IDF) and latent coordinates of all terms, and which are rare, from every passage of every document.

    A randomised range finder: the Gram matrix AᵀA of the passages times a thin random matrix, as sums over the
    passages of each task that are then added up per term, made orthogonal.
    Columns are scaled to equal length first, so that rare terms, which tell passages apart, are not cut off.
    """
    n_terms = len(benchmark.terms)
    rows = numbered.mapInArrow(_frequencies(n_terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    seen = np.zeros(n_terms)
    seen[term[term >= 0]] = n[term >= 0]
    passages = max(1, int(n[term < 0].sum()))
    # Above 0 for every term, so an item that is in most passages is still found.
    idf = np.log1p(passages / (seen + 1))
    scale = 1 / np.sqrt(seen + 1)
    basis = np.random.default_rng(seed).standard_normal((n_terms, min(rank, n_terms)))
    sums = [F.sum(F.get("row", F.lit(k))).alias(f"c{k}") for k in range(basis.shape[1])]
    shared = spark.sparkContext.broadcast((scale, basis))
    product = numbered.mapInArrow(_gram(shared, n_terms), "term long, row array<double>").groupBy("term").agg(*sums).toArrow()
    image = basis * 1e-6
    at = product.column("term").to_numpy()
    image[at] += np.column_stack([product.column(f"c{k}").to_numpy() for k in range(basis.shape[1])]) if len(at) else 0
    return idf, np.linalg.qr(image)[0], seen <= COMMON * passages


def _common_length(item: list[int], passage: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence, and the first and last word of the passage that take part."""
    places: dict[int, int] = {}
    for i, t in enumerate(item):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row, first, last, best = full, -1, -1, 0
    for at, t in enumerate(passage):
        hit = places.get(t, 0)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
            now = len(item) - row.bit_count()
            if now > best:
                first, last, best = at if first < 0 else first, at, now
    return best, first, last


def _holders(words: list[np.ndarray], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a block that have each rare term: first place of each term, and the items."""
    pairs = np.unique(np.concatenate([np.unique(w[rare[w]]).astype(np.int64) * len(words) + i for i, w in enumerate(words)]))
    return np.searchsorted(pairs, np.arange(len(rare) + 1) * len(words)), pairs % len(words)


def _near(words: np.ndarray, stride: np.ndarray, n: int, place: np.ndarray, bounds: tuple, reach: np.ndarray, holders: tuple) -> np.ndarray:
    """For each passage and each item of a block: how many words around it are rare terms of the item.

    Around is from ``reach`` strides before to ``reach`` after the passage, within the document: no word that a
    comparison may match is left out. ``words`` are rare terms and ``stride`` the stride of each, of ``n``; ``place``
    is the first stride of each passage, ``bounds`` the first and last (exclusive) of its document.
    """
    start, items = holders
    held = start[words + 1] - start[words]
    item = items[np.repeat(start[words] - np.cumsum(held) + held, held) + np.arange(held.sum())]
    counts = np.bincount(np.repeat(stride, held) * len(reach) + item, minlength=n * len(reach)).reshape(n, -1)
    sums = np.zeros((n + 1, len(reach)), np.int32)
    np.cumsum(counts, axis=0, out=sums[1:])
    out = np.empty((len(place), len(reach)), np.int32)
    for r in np.unique(reach):
        mine = np.flatnonzero(reach == r)
        out[:, mine] = sums[np.minimum(place + 2 + r, bounds[1])][:, mine] - sums[np.maximum(place - r, bounds[0])][:, mine]
    return out


def _searcher(shared, cosine: float, subsequence: float, answer: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark, idf, basis, rare = shared.value
        coordinates = np.ascontiguousarray((idf[:, None] * basis).T)
        targets = np.array([coordinates[:, w].sum(axis=1) for w in benchmark.words], np.float32).reshape(-1, basis.shape[1])
        targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
        items = [w.tolist() for w in benchmark.words]
        distinct = [set(w) for w in items]
        step = max(1, CELLS // STEP)
        # A confirmed item misses at most ``spare`` of its words. All its other rare ones are among the words that
        # are compared, which reach its own length beyond the passage; fewer there rule a candidate out.
        size = np.array([len(w) for w in benchmark.words])
        spare = size - np.ceil(subsequence * size - 1e-9).astype(int)
        least = np.array([rare[w].sum() for w in benchmark.words]) - spare
        reach = -(-size // STRIDE)

        @lru_cache(1)
        def holders(k: int) -> tuple[np.ndarray, np.ndarray]:
            return _holders(benchmark.words[k : k + step], rare)

        # The answer of an item is the quarter of its terms that are rarest.
        answers = [set(sorted(set(w), key=lambda t: (-idf[t], t))[: -(-len(set(w)) // 4)]) for w in items]
        for batch in batches:
            words, stride, strides = _passages(batch)
            offsets = utf8(batch.column("words"))[1] // 4
            keep = np.flatnonzero(words >= 0)
            held = stride[keep]
            some_rare = keep[rare[words[keep]]]
            held_rare = stride[some_rare]
            begin = np.repeat(offsets[:-1], np.diff(strides)) + (np.arange(strides[-1]) - np.repeat(strides[:-1], np.diff(strides))) * STRIDE
            final = np.zeros(strides[-1] + 1, bool)
            final[strides[1:] - 1] = True  # the last stride of a document is a passage by itself
            owner = np.repeat(np.arange(batch.num_rows), np.diff(strides))

            def compare(at: int, item: int, close: float) -> None:
                doc = int(owner[at])
                a, b = int(offsets[doc]), int(offsets[doc + 1])
                size = len(items[item])
                from_, to = max(a, int(begin[at]) - size), min(b, int(begin[at]) + 2 * STRIDE + size)
                around = words[from_:to].tolist()
                if len(distinct[item].intersection(around)) < len(distinct[item]) - spare[item]:
                    return
                length, first, last = _common_length(items[item], around)
                if length < subsequence * size:
                    return
                share = len(answers[item] & set(words[from_ + first : from_ + last + 1].tolist())) / len(answers[item])
                if share >= answer:
                    row = (length / size, close, share, from_ + first - a, from_ + last + 1 - a)
                    found[doc, item] = max(found.get((doc, item), row), row)

            found: dict[tuple[int, int], tuple] = {}
            for i in range(0, int(strides[-1]), STEP):
                j = min(i + STEP, int(strides[-1]))
                a, b = np.searchsorted(held, [i, j + 1])
                sums = _sums(held[a:b] - i, coordinates, words[keep[a:b]], j - i + 1).T.astype(np.float32)
                passage = sums[:-1] + np.where(final[i:j, None], np.float32(0), sums[1:])
                norm = np.linalg.norm(passage, axis=1)
                some = np.flatnonzero(norm > 0)
                passage = passage[some] / norm[some, None]
                # The strides around these as well, as far as any item reaches.
                low, high = max(0, i - int(reach.max())), min(int(strides[-1]), j + 1 + int(reach.max()))
                a, b = np.searchsorted(held_rare, [low, high])
                bounds = np.maximum(strides[owner[some + i]] - low, 0), np.minimum(strides[owner[some + i] + 1], high) - low
                for k in range(0, len(items), step):
                    mine = slice(k, k + step)
                    near = _near(words[some_rare[a:b]], held_rare[a:b] - low, high - low, some + i - low, bounds, reach[mine], holders(k))
                    close = passage @ targets[mine].T
                    for p, q in zip(*np.nonzero((close >= cosine) & (near >= least[mine])), strict=True):
                        compare(int(some[p]) + i, int(q) + k, float(close[p, q]))
            if found:
                docs, which = (np.array(x) for x in zip(*found, strict=True))
                common, close, share, first, end = zip(*found.values(), strict=True)
                columns = [batch.column("id").take(pa.array(docs)), pa.array([benchmark.ids[i] for i in which])]
                columns += [pa.array(x) for x in (close, common, share, first, end)]
                names = ["id", "item_id", "cosine", "common", "answer", "first_word", "end_word"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return search


def contaminated(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    cosine: float = COSINE,
    subsequence: float = SUBSEQUENCE,
    answer: float = ANSWER,
) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item_id, cosine, common, answer, first_word, end_word.

    Every document is cut into overlapping passages of 32 words, 16 apart. Passages and items are TF-IDF
    vectors in a latent space found by a randomised SVD of all passages. A passage with a cosine of at least
    ``cosine`` to an item is a candidate; one whose surroundings hold too few of the item's terms for what follows
    is ruled out by counts. It is confirmed if the longest common subsequence of the item's words
    and the words around the passage has at least ``subsequence`` of the item's words (``common``), and if at
    least ``answer`` of the item's rarest terms occur in it. Case and marks are not looked at, so reworded and
    re-set copies are found.

    A null or empty text, and an item without a word, give nothing; repeated rows each give their rows; texts of
    any length are read whole; an empty table on either side gives no rows; other columns are not looked at.
    The benchmark is broadcast, its size checked. Nothing else moves but sums per benchmark term.
    """
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()]
    schema = f"id {kinds[0]}, item_id {kinds[1]}, cosine double, common double, answer double, first_word long, end_word long"
    benchmark = read_benchmark(items, item_id_col, item_text_col)
    if not benchmark.ids:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(benchmark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    numbered = stored(rows.mapInArrow(_numberer(shared), f"id {kinds[0]}, words binary"))
    model = spark.sparkContext.broadcast((benchmark, *latent_space(spark, numbered, benchmark)))
    return numbered.mapInArrow(_searcher(model, cosine, subsequence, answer), schema)


def drop_contaminated(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows are looked at, not ids: a row with a null id goes if its text holds an item, and one that shares its id
    with such a row does not. Null and empty texts stay, texts of any length are read whole, repeated rows share
    their fate, columns of any name pass through; an empty table, or an empty benchmark, changes nothing.
    """
    rows, row = numbered_rows(docs)
    texts = rows.select(F.col(row).alias("id"), F.col(text_col).alias("text"))
    found = contaminated(spark, texts, items, "id", "text", item_id_col, item_text_col)
    gone = stored(found.select(F.col("id").alias(row)).distinct())
    return rows.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)  # the same join at every size
