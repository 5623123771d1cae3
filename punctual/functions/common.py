from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Union[Column, str]


def to_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL condition counts as 0 (pandas compares NaN as False)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))
