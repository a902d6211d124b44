"""Column names, settled when the plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capitalised(name: str) -> str:
    """First letter in upper case, the rest as it is: ``windOnshore`` gives ``WindOnshore``."""
    return name[:1].upper() + name[1:]


def capitalise_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Capitalise every column name but those in ``keep``."""
    kept = set(keep)
    return df.select([F.col(c).alias(c if c in kept else capitalised(c)) for c in df.columns])
