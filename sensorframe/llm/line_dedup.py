"""Repeated lines or paragraphs, and sentences in them, across documents, found by digests of normalised units."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import bitmap, marked, slot_of
from sensorframe.session import stored

LINE, PARAGRAPH = "\n", "\n\n"
# Characters of the shortest line, and of the shortest sentence within a line, that is removed: a page's "Home", a
# closing bracket or "See above." repeat in clean text. Characters and not words, for scripts without blanks.
LEAST_UNIT, LEAST_SENTENCE = 12, 32
BITMAP_BITS = 25

_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
_SENTENCE_BYTES = re.compile(_SENTENCE.pattern.encode())
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _long(unit: bytes, least: int) -> bool:
    """Whether a text in UTF-8 has so many characters."""
    return len(unit) >= least and (len(unit) >= 4 * least or len(unit.decode()) >= least)


def _digester(separator: str, least_unit: int, least_sentence: int | None):
    """Rows (id, unit, piece, digest) of all units, piece 0, and of the sentences of units that have several."""
    cut = separator.encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, units, pieces, digests = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                # A-Z lowered at once; runs of blanks become one where a unit is taken.
                for u, unit in enumerate((text.as_py() or "").encode().translate(_LOWER).split(cut)):
                    normal = b" ".join(unit.split())
                    if _long(normal, least_unit):
                        place.append(i), units.append(u), pieces.append(0), digests.append(md5(normal).digest())
                    if least_sentence is None or len(normal) <= least_sentence:
                        continue
                    sentences = _SENTENCE_BYTES.findall(unit)
                    for p, sentence in enumerate(sentences if len(sentences) > 1 else (), 1):
                        normal = b" ".join(sentence.split())
                        if _long(normal, least_sentence):
                            place.append(i), units.append(u), pieces.append(p), digests.append(md5(normal).digest())
            columns = [batch.column("id").take(pa.array(place, pa.int32())), pa.array(units, pa.int32()), pa.array(pieces, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary())], ["id", "unit", "piece", "digest"])

    return digest


def _without(text: str, separator: str, gone: set[tuple[int, int]]) -> tuple[int, list[dict], str]:
    """Number of units, the removed spans, and the text without them."""
    units, spans, kept, at = text.split(separator), [], [], 0
    touched = {u for u, _ in gone}
    for u, unit in enumerate(units):
        if (u, 0) in gone:
            spans.append({"unit": u, "start": at, "end": at + len(unit)})
        elif u in touched:
            rest, begin = [], at
            for p, sentence in enumerate(_SENTENCE.findall(unit), 1):
                if (u, p) in gone:
                    spans.append({"unit": u, "start": begin, "end": begin + len(sentence)})
                else:
                    rest.append(sentence)
                begin += len(sentence)
            kept.append("".join(rest))
        else:
            kept.append(unit)
        at += len(unit) + len(separator)
    return len(units), spans, separator.join(kept)


def _cutter(separator: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                out.append(_without(text, separator, {(g["unit"], g["piece"]) for g in gone or []}))
            span = pa.struct([("unit", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
            n, removed, kept = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int32()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())],
                ["id", "n_units", "removed", "kept_text"],
            )

    return cut


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: str = LINE,
    least_unit: int = LEAST_UNIT,
    least_sentence: int | None = LEAST_SENTENCE,
) -> DataFrame:
    """One row per document: id, n_units, removed (array of unit, start, end), kept_text.

    The text is cut at each ``separator`` into units (lines, or paragraphs), and units of several sentences into these,
    after marks of the kind ``.!?``; so a passage that stands within a longer line is met too. A unit or sentence is
    removed if one with the same normalised text stands earlier: in a document with a smaller id, or before it in the
    same one (the unit before its sentences). Normalised is A-Z in lower case and runs of blanks as one, none at the
    ends. Units under ``least_unit`` and sentences under ``least_sentence`` characters stay and are not compared; 1
    compares all, and no sentences are looked at if the latter is None.

    ``start`` and ``end`` are places in the original text in code points, end exclusive. ``kept_text`` is the units that
    stay, without their removed sentences, joined by the separator again. Null counts as empty, which is one empty
    unit. Texts of any length are read whole. Rows of equal id are one document to the ranking and each get a row; a
    row with a null id keeps everything and takes nothing. An empty table gives no rows; other columns are not looked at.

    Units travel as 128-bit digests. Their number and first place come from partial aggregates, so a line
    in a third of all documents is a row per task there, and the join back to the units splits a frequent
    digest. Only texts that lose a unit are moved, found by a bitmap of bounded size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    units = rows.where("id is not null").mapInArrow(
        _digester(separator, least_unit, least_sentence), f"id {kind}, unit int, piece int, digest binary"
    )
    units = stored(units)
    place = F.struct("id", "unit", "piece")
    first = units.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    first = stored(first.where("n > 1").select("digest", "first"))
    gone = units.join(first, "digest").where(place != F.col("first"))
    gone = stored(gone.groupBy("id").agg(F.collect_set(F.struct("unit", "piece")).alias("gone")))

    rows = marked(rows, slot_of(BITMAP_BITS, "id"), bitmap(gone.select(slot_of(BITMAP_BITS, "id").alias("slot"))), "hit")
    none = F.array().cast("array<struct<unit:int,start:bigint,end:bigint>>")
    pattern = separator.replace("\n", "\\n")
    whole = rows.where("not hit or id is null").select(
        "id", F.size(F.split("text", pattern, -1)).alias("n_units"), none.alias("removed"), F.col("text").alias("kept_text")
    )
    # The same join at every size: these texts are dealt out by id.
    cut = rows.where("hit and id is not null").select("id", "text").join(gone.hint("merge"), "id", "left")
    cut = cut.mapInArrow(
        _cutter(separator), f"id {kind}, n_units int, removed array<struct<unit:int,start:bigint,end:bigint>>, kept_text string"
    )
    return whole.unionByName(cut)
