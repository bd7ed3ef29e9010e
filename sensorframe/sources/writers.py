"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_twice(df: DataFrame, first: str, second: str, **kwargs) -> None:
    """The same result to two places.

    The second copy is read back from the first, so the plan runs once and nothing is lost when an
    executor that would have held a cached copy goes away.
    """
    write_table(df, first, **kwargs)
    fmt = kwargs.get("fmt", "parquet")
    reader = df.sparkSession.read.format(fmt).schema(df.schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("nullValue", "NA")
    write_table(reader.load(first), second, **kwargs)
