"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import bitmap, marked, numbered_rows, slot_of
from sensorframe.session import stored

WHITE_SPACE = r"[ \t-\r]+"
BITMAP_BITS = 25


def normalised(text: str) -> Column:
    """The text without blanks and line ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix: int = 64,
    bits: int = BITMAP_BITS,
    all_digests: bool = False,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest.

    Texts are equal when they are identical after all blanks, tabs and line ends are deleted; null counts as
    empty, and all empty texts are one group. Of a group the row with the longest original text stays, then
    the smallest id, a null id last; of repeated rows exactly one stays. An empty table gives no rows; other
    columns are not looked at.

    A first scan takes the length and a hash of the first ``prefix`` characters of each text. Groups of equal
    length are cut by the prefix hash; keys that still have several rows set bits in a bitmap of ``1 << bits``
    bits, whose size does not depend on the data. A second scan takes the full hash (SHA-256) of the texts
    whose key is in the bitmap, so a false hit costs a hash and changes nothing. ``digest`` is null for texts
    that were not looked at in full, unless ``all_digests``. No text is shuffled, and rows of a hot group
    carry keys only; its size and its survivor come from partial aggregates.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), normalised("text").alias("norm"))
    keyed = texts.withColumns({"size": F.octet_length("norm"), "head": F.xxhash64(F.substring("norm", 1, prefix))})

    # Counts by both keys first: a group of copies is one row from then on.
    keys = stored(keyed.groupBy("size", "head").count())
    sizes = keys.groupBy("size").agg(F.sum("count").alias("n")).where("n > 1").select("size")
    alive = keys.join(sizes, "size", "left_semi").where("count > 1")
    found = marked(keyed, slot_of(bits, "size", "head"), bitmap(alive.select(slot_of(bits, "size", "head").alias("slot"))), "alive")
    alive = F.col("alive")
    rows = stored(
        found.select(
            "id",
            "chars",
            "alive",
            F.when(F.lit(True) if all_digests else alive, F.sha2("norm", 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("z"), "id", "row"))
    groups = rows.where("alive").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    groups = stored(groups.where("n > 1").select(F.col("digest").alias("key"), "n", "best.id", "best.row"))

    rows = rows.withColumn("key", F.when(F.col("alive"), F.col("digest"))).alias("r")
    groups, mine = groups.alias("g"), F.col("g.n").isNull()
    return rows.join(groups, F.col("r.key") == F.col("g.key"), "left").select(
        F.col("r.id").alias("id"),
        F.when(mine, F.col("r.id")).otherwise(F.col("g.id")).alias("keep_id"),
        F.coalesce(F.col("g.n"), F.lit(1)).cast("long").alias("group_size"),
        (mine | (F.col("r.row") == F.col("g.row"))).alias("kept"),
        F.col("r.digest").alias("digest"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    The decision is one of rows, not of ids: of a group of equal texts one row stays, repeated rows and null ids
    included, and a row that shares its id with a dropped one is not touched. Rows are numbered once and stored.
    """
    rows, row = numbered_rows(docs)
    # The order of exact_dedup, down to the row: smallest id, a null id last, then the row.
    key = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    decided = exact_dedup(rows.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text")
    gone = decided.where(~F.col("kept")).select(F.col("id.row").alias(row))
    return rows.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)  # the same join at every size
