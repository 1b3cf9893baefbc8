"""The tables behind the report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.operators.joins import lookup_join
from signalspark.operators.ordered import exact_quantiles
from signalspark.sources.results import export_tables
from signalspark.storage import materialize

# Bins of the score histogram, names of the compared variants.
BINS = 50
VARIANT_NAMES = {"baseline": "Baseline", "flat_sentiment": "Flat Sentiment",
                 "decay_sentiment": "Decay Sentiment"}
COMPARED = ("accuracy_mean", "f1_mean", "auc_mean", "sharpe_ratio_mean")


def score_histogram(scored: DataFrame, score: str = "sentiment_score", bins: int = BINS) -> DataFrame:
    """Count per equal-width bin over the range of the data; the top edge is in the last bin."""
    edges = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    if edges.lo is None:
        return scored.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_left"),
                             F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi = float(edges.lo), float(edges.hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    inside = F.least(F.width_bucket(F.col(score), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    width = (hi - lo) / bins
    return (scored.filter(F.col(score).isNotNull()).groupBy(inside.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_left"), "n"))


def score_boxplot(scored: DataFrame, score: str = "sentiment_score", by: str = "Ticker",
                  **limits: int) -> DataFrame:
    """Quartiles, whiskers (outermost values within 1.5 IQR) and outlier count per entity."""
    counts = materialize(scored.filter(F.col(score).isNotNull()).groupBy(by, score)
                         .agg(F.count(F.lit(1)).alias("n")), "score_counts")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = materialize(exact_quantiles(counts, [by], score, probs, F.col("n"), **limits),
                            "quartiles")
    rows = lookup_join(counts, quartiles, [by], "inner", [score])
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col(score).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(score))).alias("whisker_low"),
        F.max(F.when(inside, F.col(score))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"))


def target_distribution(market: DataFrame) -> DataFrame:
    """Rows per target value."""
    return market.groupBy("Target").agg(F.count(F.lit(1)).alias("n"))


def score_profile(scored: DataFrame, score: str = "sentiment_score", by: str = "Ticker") -> DataFrame:
    """Rows, scored rows, and mean and range of the score per entity."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("items"), F.count(score).alias("scored"), F.avg(score).alias("mean"),
        F.min(score).alias("lowest"), F.max(score).alias("highest"))


def sentiment_coverage(merged: DataFrame, column: str = "sent_mean", by: str = "Ticker") -> DataFrame:
    """Market days, and days with sentiment, per entity."""
    return merged.groupBy(by).agg(F.count(F.lit(1)).alias("days"),
                                  F.count(column).alias("days_with_sentiment"))


def compared_metrics(comparison: DataFrame) -> DataFrame:
    """The headline metrics of the comparison that exist, one row per variant and model."""
    return comparison.select("Model", "model_type", *[c for c in COMPARED if c in comparison.columns])


def variant_names(comparison: DataFrame) -> DataFrame:
    """Add the display name of each variant."""
    pairs = [F.lit(v) for kv in VARIANT_NAMES.items() for v in kv]
    name = F.create_map(*pairs)[F.col("variant")]
    return comparison.withColumn("Model", F.coalesce(name, F.col("variant")))


def key_findings(comparison: DataFrame) -> DataFrame:
    """Model of the highest Sharpe ratio and AUC change of decay over baseline, in percent."""
    auc = {v: F.max(F.when(F.col("Model") == v, F.col("auc_mean")))
           for v in ("Decay Sentiment", "Baseline")}
    change = (auc["Decay Sentiment"] - auc["Baseline"]) / auc["Baseline"] * F.lit(100.0)
    order = F.struct("sharpe_ratio_mean", "Model")
    return comparison.filter(F.col("sharpe_ratio_mean").isNotNull()).agg(
        F.max_by("Model", order).alias("best_model"),
        F.max("sharpe_ratio_mean").alias("best_sharpe"),
        change.alias("auc_improvement_pct"))


def write_report(tables: Mapping[str, DataFrame | None], folder: str, prefix: str = "results",
                 fmt: str = "csv") -> list[str]:
    """Write the report tables that exist."""
    return export_tables(tables, folder, prefix, fmt)
