"""Daily bars: one row per (Ticker, Date)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.sources.checks import nan_to_null, require_columns

# Columns of a bar file.
BAR_COLUMNS = ("Date", "Open", "High", "Low", "Close", "Volume")
PRICE_COLUMNS = BAR_COLUMNS[1:]


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None,
               multi_line: bool = False) -> DataFrame:
    """Parquet, or CSV with a header and all columns as text (typed by the caller).

    Without ``fmt`` the ending decides. ``multi_line`` allows line feeds within CSV
    values, at the price of one task per file.
    """
    first = path if isinstance(path, str) else path[0]
    if fmt is None:
        fmt = "csv" if first.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet"
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.format(fmt).load(path if isinstance(path, str) else list(path))


def standardize_bars(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Typed bars with a ``Ticker`` column; bars without a close keep their day.

    Duplicate (Ticker, Date) bars collapse to the smallest (Open, High, Low,
    Close, Volume). The duplicates are combined before the shuffle, so one hot
    key costs nothing, and from here on a ticker has at most one row per day.
    """
    if ticker is not None:
        df = df.withColumn("Ticker", F.lit(ticker))
    require_columns(df, [*BAR_COLUMNS, "Ticker"])
    typed = df.select("Ticker", F.to_date("Date").alias("Date"),
                      *[F.col(c).cast("double").alias(c) for c in PRICE_COLUMNS])
    typed = nan_to_null(typed, PRICE_COLUMNS)
    first = F.min(F.struct(*PRICE_COLUMNS)).alias("bar")
    return typed.groupBy("Ticker", "Date").agg(first).select("Ticker", "Date", "bar.*")


def load_bars(spark: SparkSession, ticker: str, path: str, fmt: str | None = None) -> DataFrame:
    """Bars of one entity from its own file."""
    return standardize_bars(require_columns(read_table(spark, path, fmt), BAR_COLUMNS), ticker)


def union_bars(frames: Sequence[DataFrame]) -> DataFrame:
    """All entities in one table."""
    return reduce(DataFrame.unionByName, frames)


def load_all_bars(spark: SparkSession, paths: Mapping[str, str], fmt: str | None = None) -> DataFrame:
    """Bars of all entities, from a map of ticker to file.

    One read and one aggregate for all files of a kind; a row's ticker follows from
    the name of its file. Folders, patterns and file names that repeat are read
    entity by entity.
    """
    names = {p.rstrip("/").rsplit("/", 1)[-1]: t for t, p in paths.items()}
    files = [p for p in paths.values() if "." in p.rsplit("/", 1)[-1] and not any(c in p for c in "*?[{")]
    kinds = {p.rsplit(".", 1)[-1] for p in files}
    if len(names) < len(paths) or len(files) < len(paths) or len(kinds) > 1 or fmt is None and kinds != {"csv"}:
        return union_bars([load_bars(spark, ticker, path, fmt) for ticker, path in paths.items()])
    rows = require_columns(read_table(spark, list(paths.values()), fmt), BAR_COLUMNS)
    tickers = spark.createDataFrame([(n, t) for n, t in names.items()], "_file string, Ticker string")
    named = rows.drop("Ticker").withColumn("_file", F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)))
    return standardize_bars(named.join(F.broadcast(tickers), "_file").drop("_file"))  # one row per file


def trading_days(bars: DataFrame) -> DataFrame:
    """Distinct (Ticker, Date)."""
    return bars.select("Ticker", "Date").distinct()
