"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """CRC-32 of the value as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, longer by underscores until no column of ``df`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def numbered_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """The stored rows with a number each, and the name of its column: what a decision about rows hangs on.

    Ids may be null or repeated; the numbers are not, and as the rows are stored, they stay the same.
    """
    row = free_name(df, "_row")
    return stored(df.withColumn(row, F.monotonically_increasing_id())), row


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each text in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slot_of(bits: int, *columns: str) -> Column:
    """Place of a key in a bitmap of ``1 << bits`` bits."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << bits))


def bitmap(slots: DataFrame) -> DataFrame:
    """(bucket, bitmap) with the bits of all slots set; 4 KB for each 32,768 bits, whatever the number of rows."""
    return slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap")
    )


def marked(rows: DataFrame, slot: Column, bits: DataFrame, out: str) -> DataFrame:
    """The rows with a boolean column: whether the bit of their slot is set. The bitmap is broadcast."""
    rows = rows.withColumn("slot", slot).withColumn("bucket", F.expr("bitmap_bucket_number(slot)"))
    rows = rows.join(F.broadcast(bits), "bucket", "left").withColumn("bit", F.expr("bitmap_bit_position(slot)"))
    byte = "cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast(bit % 8 as int)) & 1, 0) = 1")
    return rows.withColumn(out, hit).drop("slot", "bucket", "bitmap", "bit")


class Lookup:
    """Whole-number keys to their index, for many queries at once; -1 where a key is missing.

    Open addressing with linear probing over numpy arrays, at most a quarter full.
    """

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.index = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.index[slot] < 0
            self.index[slot[free]] = left[free]
            taken = self.index[slot] == left
            self.keys[slot[taken]] = keys[left[taken]]
            left, slot = left[~taken], (slot[~taken] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.index[slot]
        open_ = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.index[slot[open_]]
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & (out[open_] >= 0)]
        return out
