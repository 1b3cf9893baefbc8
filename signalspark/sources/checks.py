"""Column checks shared by the readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged or raise ``ValueError`` naming what is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def nan_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn NaN into null, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
