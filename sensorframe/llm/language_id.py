"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.llm.common import Lookup, numbered_rows, utf8
from sensorframe.session import stored

ORDER = 4
# Nodes that are sent to the tasks at once; more are scored in several passes over the texts.
NODES = 2_000_000
SLICE = 2_000_000


def _codes(data: np.ndarray, starts: np.ndarray, begin: int, end: int, order: int) -> np.ndarray:
    """For each byte of data[begin:end] the byte and up to ``order`` bytes before it in its text, as one number.

    Bytes before the start of a text count as zero. ``starts`` are the first bytes of the texts, sorted.
    """
    back = max(0, begin - order)
    code = data[back:end].astype(np.uint64)
    out = code.copy()
    for j in range(1, order + 1):
        out[j:] |= code[:-j] << np.uint64(8 * j) if len(code) > j else 0
    out = out[begin - back :]
    near = starts[np.searchsorted(starts, begin - order) : np.searchsorted(starts, end)]
    for j in range(order):
        at = near + j - begin
        at = at[(at >= 0) & (at < len(out))]
        # A later start overrules an earlier one, as masks only clear bits.
        out[at] &= np.uint64((1 << (8 * (j + 1))) - 1)
    return out


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            data, offsets = utf8(batch.column("text"))
            starts = offsets[:-1][np.diff(offsets) > 0]
            for begin in range(0, len(data), SLICE):
                end = min(len(data), begin + SLICE)
                code = _codes(data, starts, begin, end, order)
                owner = np.searchsorted(offsets, np.arange(begin, end), side="right") - 1 if len(set(langs)) > 1 else None
                for lang in sorted(set(langs)):
                    mine = code if owner is None else code[(langs == lang)[owner]]
                    held.setdefault(lang, []).append(np.unique(mine, return_counts=True))
                    if len(held[lang]) >= 16:
                        held[lang] = [_merge(held[lang])]
        for lang, parts in held.items():
            codes, n = _merge(parts)
            for i in range(0, len(codes), 100_000):
                part = codes[i : i + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part), pa.array(n[i : i + 100_000])], ["lang", "code", "n"]
                )

    return count


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([p[0] for p in parts])
    order = np.argsort(codes)
    codes, n = codes[order], np.concatenate([p[1] for p in parts]).astype(np.int64)[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(codes) else n


def count_contexts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each byte follows each ``order`` bytes, over all given texts.

    Counts are combined within a task before they are shuffled.
    """
    return docs.select("lang", "text").mapInArrow(_counter(order), "lang string, code long, n long").groupBy(
        "lang", "code"
    ).agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Frozen trees of all languages: the table of their nodes, and how it is cut into passes.

    ``nodes`` has for each order k, language and code (a byte and the k before it) how often it occurs (``n``), and how
    often (``s``) and with how many next bytes (``d``) its context does. ``passes`` are ranges of the two bytes before a byte:
    all contexts of order 2 and more with these two bytes, and all longer ones they end in, are in the same range.
    """

    order: int
    langs: list[str]
    nodes: DataFrame | None
    passes: list[tuple[int, int]]

    def levels(self, first: int, last: int) -> list[tuple]:
        """Code lengths in bits by order, for grams and for escapes, of the nodes that a pass needs."""
        pair = _pair(F.col("code"))
        nodes = self.nodes.where((F.col("k") < 2) | pair.between(first, last)).toArrow()
        order, out = nodes.column("k").to_numpy(), []
        for k in range(self.order + 1):
            t = nodes.filter(pa.array(order == k))
            lang = np.searchsorted(np.array(self.langs, object), np.array(t.column("lang").to_pylist(), object))
            code = t.column("code").to_numpy().astype(np.uint64)
            n, s, d = (t.column(c).to_numpy().astype(float) for c in "nsd")
            p = n / (s + d)
            contexts, owner = np.unique(code >> np.uint64(8), return_inverse=True)
            left = np.ones((len(contexts), len(self.langs)))
            np.subtract.at(left, (owner, lang), p)
            escape = -np.log2(np.maximum(left, 1e-12)).astype(np.float32)
            escape[left >= 1.0] = 0.0
            grams = np.unique(code)
            bits = np.full((len(grams), len(self.langs)), 8.0, np.float32)
            if k:
                bits = _lengths([(Lookup(g), b, Lookup(c), e) for g, b, c, e in out], grams & np.uint64((1 << (8 * k)) - 1))
            bits = bits + escape[np.searchsorted(contexts, grams >> np.uint64(8))]
            bits[np.searchsorted(grams, code), lang] = -np.log2(p)
            out.append((grams, bits.astype(np.float32), contexts, escape))
        return out


def _pair(code: Column) -> Column:
    return F.shiftright(code, 8).bitwiseAND(F.lit(0xFFFF))


def train(docs: DataFrame, order: int = ORDER, least: int = 1, at_once: int | None = None) -> Model:
    """Trees from all given rows (lang not null, text).

    In a context seen n times with d different next bytes, a byte seen m times has probability m / (n + d).
    What is left is the escape to the next shorter context; below order 0 all 256 bytes are alike. Every byte
    that occurs at least ``least`` times in a context is a node (all by default), so the trees grow with the corpus; rarer ones
    are priced by the escape. The nodes stay a stored table. They are scored in passes of at most ``at_once``
    nodes (default ``NODES``), and only the nodes of one pass are ever sent to the driver and to a task.
    """
    counts = stored(count_contexts(docs, order))
    tables = None
    for k in range(order + 1):
        grams = counts if k == order else counts.withColumn("code", F.col("code").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)))
        grams = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
        # At most 256 rows share a context.
        context = W.partitionBy("lang", F.shiftright("code", 8))
        grams = grams.withColumns({"s": F.sum("n").over(context), "d": F.count("n").over(context)})
        grams = grams.where(F.col("n") >= least).select(F.lit(k).alias("k"), "lang", "code", "n", "s", "d")
        tables = grams if tables is None else tables.unionByName(grams)
    nodes = stored(tables)
    langs = sorted(r["lang"] for r in nodes.where("k = 0").select("lang").distinct().collect())
    # At most 65,536 rows: nodes by the two bytes before them.
    sizes = nodes.where("k > 1").groupBy(_pair(F.col("code")).alias("pair")).agg(F.count(F.lit(1)).alias("n")).orderBy("pair").collect()
    passes, first, held = [], 0, 0
    for r in sizes:
        if held and held + r["n"] > (at_once or NODES):
            passes.append((first, r["pair"] - 1))
            first, held = r["pair"], 0
        held += r["n"]
    return Model(order, langs, nodes, [*passes, (first, 0xFFFF)])


def _lengths(levels: list[tuple], codes: np.ndarray) -> np.ndarray:
    """Code length of the last byte of each code, per language, by the longest contexts known."""
    grams, bits, contexts, escape = levels[-1]
    at = grams(codes)
    out = bits[at] if len(bits) else np.full((len(codes), bits.shape[1]), 8.0, np.float32)
    missing = np.flatnonzero(at < 0) if len(bits) else np.arange(len(codes))
    if len(missing):
        rest = codes[missing]
        cost = np.full((len(rest), bits.shape[1]), 8.0, np.float32)
        if len(levels) > 1:
            cost = _lengths(levels[:-1], rest & np.uint64((1 << (8 * (len(levels) - 1))) - 1))
        if len(escape):
            known = contexts(rest >> np.uint64(8))
            cost = cost + np.where(known[:, None] >= 0, escape[known], np.float32(0))
        out[missing] = cost
    return out


def _scorer(shared, order: int, n_lang: int, first: int, last: int):
    """Code lengths by language of the bytes of each text whose two bytes before are in the range of a pass."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [(Lookup(g), bits, Lookup(c), escape) for g, bits, c, escape in shared.value]
        whole = (first, last) == (0, 0xFFFF)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            total = np.zeros((batch.num_rows, n_lang))
            full = np.flatnonzero(np.diff(offsets) > 0)
            starts = offsets[:-1][full]
            for begin in range(0, len(data) if n_lang else 0, SLICE):
                end = min(len(data), begin + SLICE)
                code = _codes(data, starts, begin, end, order)
                if whole:
                    bits = _lengths(levels, code)
                else:
                    pair = (code >> np.uint64(8)) & np.uint64(0xFFFF)
                    mine = np.flatnonzero((pair >= first) & (pair <= last))
                    bits = np.zeros((len(code), n_lang), np.float32)
                    bits[mine] = _lengths(levels, code[mine])
                a, b = np.searchsorted(starts, begin, side="right") - 1, np.searchsorted(starts, end)
                total[full[a:b]] += np.add.reduceat(bits, np.maximum(starts[a:b] - begin, 0), axis=0, dtype=np.float64)
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets)), pa.array(list(total), pa.list_(pa.float64()))], [*names, "n_bytes", "bits"])

    return score


def code_lengths(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    """Rows (all columns but ``text``, then n_bytes and bits): the exact code length of the whole text in each language.

    With one pass the texts are read once. With several, rows are numbered and stored, every pass adds up the bytes
    it knows the contexts of, and its small result is stored before the next one begins.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text") + ", n_bytes long, bits array<double>"
    n = len(model.langs)

    def one(table: DataFrame, schema: str, first: int, last: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(model.levels(first, last) if n else [])
        return table.mapInArrow(_scorer(shared, model.order, n, first, last), schema)

    if len(model.passes) == 1 or not n:
        return one(rows, schema, 0, 0xFFFF)
    numbered, row = numbered_rows(rows)
    parts = None
    for first, last in model.passes:
        part = stored(one(numbered.select(row, "text"), f"`{row}` long, n_bytes long, bits array<double>", first, last))
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy(row).agg(F.first("n_bytes").alias("n_bytes"), F.array(*[F.sum(F.col("bits")[i]) for i in range(n)]).alias("bits"))
    return numbered.drop("text").join(sums, row).drop(row)


def identify(
    spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_bytes, lang_pred, score.

    ``lang_pred`` is the language whose frozen tree gives the whole text the shortest exact code length, the
    first in alphabetical order on a tie; ``score`` is its share of the probabilities of all languages.
    A null, empty or letterless text, or a model without languages, gives ``und`` with score 0. Texts of any
    length are priced in slices; repeated rows each get a row; an empty table gives no rows; other columns
    are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = code_lengths(spark, rows, model).withColumn("least", F.array_min("bits"))
    known = F.col("letters") & F.col("least").isNotNull()
    names = F.array(*[F.lit(x) for x in model.langs]).cast("array<string>")
    place = F.array_position("bits", F.col("least")).cast("int")
    odds = F.aggregate("bits", F.lit(0.0), lambda total, b: total + F.pow(F.lit(2.0), -F.least(b - F.col("least"), F.lit(1000.0))))
    return out.select(
        "id",
        "n_bytes",
        F.when(known, F.get(names, place - 1)).otherwise("und").alias("lang_pred"),
        F.when(known, 1 / odds).otherwise(0.0).alias("score"),
    )
