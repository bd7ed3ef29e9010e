"""Text and label expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.nulls import col, if_else


# Label of a group with several labels.
SEVERAL = "b"


def recode(c: Column | str, labels: Mapping[str, str]) -> Column:
    """Replace known values by their label; others stay as they are."""
    x = col(c)
    table = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(F.element_at(table, x), x)


def rank_of(c: Column | str, order: Sequence) -> Column:
    """1-based position in a fixed order; null for a value outside it."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), col(c))
    return F.nullif(position, F.lit(0)).cast("int")


def split_part(c: Column | str, index: int, separator: str = "_") -> Column:
    """The ``index``-th part (1-based); null when there are fewer parts."""
    return F.try_element_at(F.split(col(c), separator), F.lit(index))


def month_from_name(c: Column | str) -> Column:
    """Month number inside a column name such as ``pisr_m7_50m``."""
    return F.regexp_extract(col(c), r"_m([0-9]+)_", 1).try_cast("int")


def sign_value(c: Column | str) -> Column:
    """1 for POS, -1 for any other text, null for null."""
    return if_else(col(c) == "POS", 1, -1)


def p_class(c: Column | str) -> Column:
    """Right-closed p-value class; an exact zero lies outside every class."""
    p = col(c)
    out = F.when(p <= 0, F.lit(None).cast("string"))
    for bound, label in K.P_CLASSES:
        out = out.when(p <= bound, F.lit(label))
    return out


def collapse_label(c: Column | str, several: str = SEVERAL) -> Column:
    """One distinct label in the group gives that label, several give a flag, none gives null."""
    x = col(c)
    return F.when(F.min(x) != F.max(x), F.lit(several)).otherwise(F.min(x))
