"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.session import stored

CAPACITY = 2048
# Words remembered by a worker, some 200 MB; the table starts anew when it is full, which costs time only.
MEMO = 1_000_000
# Below U+0180 no letter combines with its neighbour, and but for two letters lower case is character by character.
UNUSUAL = re.compile("[^\x00-\u012f\u0132-\u017f]")
LAST_MARK = re.compile(r"(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])([.,])(?=[ \n]|$)")
# Parts into which the pieces of one length are split to be numbered.
PARTS = 64


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that drops white space and never joins across it.

    Each blank-separated chunk is tokenised once and remembered. In texts of usual letters, capitals are lowered
    first and a full stop or comma behind a word is cut off it, as the tokenizer does both itself. New words
    are tokenised many at a time and told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Kept with the library's module, as that outlives a task while Spark reuses the worker.
        self.chunks: dict[str, bytes] = tokenizers.__dict__.setdefault("_known_chunks", {}).setdefault(path, {"": b""})

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """As ``_encode`` for words of letters only, or one mark."""
        raw = b"".join(self._encode([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]))
        stops = 4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)
        if len(stops) != len(words):
            return self._encode(words)
        stops = stops.tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, chunks: set[str]) -> None:
        words = [c for c in chunks if c.isalpha()]
        others = [c for c in chunks if not c.isalpha()]
        self.chunks.update(zip(words, self._encode_words(words), strict=True))
        self.chunks.update(zip(others, self._encode(others), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.chunks) > MEMO:
            self.chunks.clear()
            self.chunks[""] = b""
        known, cut = self.chunks, []
        for text in texts:
            if not UNUSUAL.search(text):
                text = LAST_MARK.sub(r" \1", text.lower())
            cut.append(text.replace("\n", " ").split(" "))
        missing = {c for chunks in cut for c in chunks if c not in known}
        if missing:
            self._learn(missing)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]


def _some(texts: list[str], most: int = 300_000) -> Iterator[list[str]]:
    """Texts in groups of about so many characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _cutter(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, size = WordTokenizer(path), 4 * capacity
        names = ["row", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows: list[tuple] = []
            texts = (t or "" for t in batch.column("text").to_pylist())
            every = (ids for group in _some(texts) for ids in tokenizer.ids(group))
            for row, ids in enumerate(every):
                ids += b"\0\0\0\0"
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append((row, at // size, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                row, *columns = zip(*rows, strict=True)
                columns = [pa.array(c, k) for c, k in zip(columns, [pa.int32()] + [pa.int64()] * 3, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row)), *columns], names)

    return cut


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids with a closing 0, cut at ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _cutter(path, capacity), f"row {kind}, piece int, start long, length long, ids_crc32 long"
    ).withColumnRenamed("row", "doc_id")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, number, offset) that place every piece.

    Documents and gaps are kept as sorted runs: a length with its number of pieces, a gap with the sequences
    that have it. Rounds go from the largest pieces down. In a round all pieces of a run seek their successor
    at once, the smallest gap that holds them; where several want the same gaps they go by rank, and the rest
    move on to the next larger gap; no gap takes more than one piece in a round. Then the gaps are updated and
    the next round begins. Pieces without a gap open new sequences. There are at most ``capacity`` lengths, so
    the work here does not grow with the number of documents.
    """
    left = dict(counts)
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of (first sequence, number)
    used, rows = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first, n))

    for length in sorted(left, reverse=True):
        while left[length]:
            updated: list[tuple[int, int, int]] = []
            for gap in sorted(g for g in gaps if g >= length):
                while left[length] and gaps.get(gap):
                    first, n = gaps[gap].pop()
                    took = min(n, left[length])
                    rows.append((length, rank[length], first, took, capacity - gap))
                    rank[length] += took
                    left[length] -= took
                    updated.append((gap - length, first, took))
                    if took < n:
                        gaps[gap].append((first + took, n - took))
                if not gaps.get(gap):
                    gaps.pop(gap, None)
            if not updated:
                # Nothing fits: open as many sequences as this run can fill by itself.
                n = -(-left[length] // max(1, capacity // length))
                rows.append((length, rank[length], used, n, 0))
                rank[length] += n
                left[length] -= n
                updated.append((capacity - length, used, n))
                used += n
            for gap, first, n in updated:
                put(gap, first, n)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(placed):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = placed.value
        keys = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            rank = batch["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, batch["length"].to_numpy(np.int64) * (1 << 48) + rank, side="right") - 1
            yield batch.drop(columns="rank").assign(sequence_id=rows[at, 2] + rank - rows[at, 1], offset=rows[at, 4])

    return place


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """The pieces (a column ``length`` from 1 to ``capacity``) with sequence_id and offset, without gaps from 0.

    The pieces of each length are numbered: part by part in a window, the parts behind one another by their
    counts. Rounds of best fit run on the sorted runs of lengths and gaps, and each piece finds its run by its
    rank. Only the number of pieces per length reaches the driver. An empty table gives no rows; repeated rows
    are pieces of their own; the columns rank, part and before must not occur.
    """
    pieces = stored(pieces.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # At most capacity x parts rows.
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = stored(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.sparkContext.broadcast(plan(total, capacity))
    number = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "start"))
    ranked = pieces.withColumn("number", number).join(F.broadcast(counts.drop("n")), ["length", "part"])
    ranked = ranked.select(
        *[c for c in pieces.columns if c != "part"], (F.col("before") + F.col("number") - 1).alias("rank")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(_placer(placed), f"{schema}, sequence_id long, offset long")
