"""Result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from signalspark.storage import materialize


def export_tables(tables: Mapping[str, DataFrame | None], folder: str, prefix: str = "results",
                  fmt: str = "csv") -> list[str]:
    """Write each table that is present and not empty to ``folder``; return the paths."""
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        df = materialize(df, name)  # computed once, for the test and the file
        if df.isEmpty():
            continue
        path = f"{folder.rstrip('/')}/{prefix}_{name}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
        written.append(path)
    return written
