"""Columns that pass through an operator, whatever their names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(df: DataFrame, *own: str) -> DataFrame:
    """``df`` with its columns named by their places, but those in ``own``, so that no name
    needs quoting or meets one of an operator's; ``toDF(*df.columns)`` names them back."""
    return df.toDF(*(c if c in own else f"c{i}" for i, c in enumerate(df.columns)))
