"""The whole study, step by step. Each step maps tables to tables; a step that is
not needed is simply not called."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.functions.text import tag_entity
from signalspark.operators.align import align_news
from signalspark.operators.attribution import (
    compare_importance, fitted_attribution, top_features)
from signalspark.operators.boosting import binned, boosted_importance, fit_boosted
from signalspark.operators.daily import apply_decay, daily_sentiment, with_normalized_time
from signalspark.operators.features import (
    add_target, feature_names, technical_table, with_sentiment)
from signalspark.operators.fold_table import FoldTable, fold_table, united
from signalspark.operators.folds import TEST
from signalspark.operators.logistic import fit_fold_logistic
from signalspark.operators.metrics import compare
from signalspark.operators.models import MODELS
from signalspark.operators.tree_shap import tree_attribution, tree_contributions
from signalspark.params import StudyParams
from signalspark.plans import report as rep
from signalspark.plans import sweep as sw
from signalspark.sources.news import dedupe_news
from signalspark.storage import materialize

Scorer = Callable[[DataFrame], DataFrame]
VARIANTS = {"baseline": None, "flat_sentiment": "flat", "decay_sentiment": "decay"}


@dataclass
class Study:
    """Tables of one run, filled by the steps in order."""

    params: StudyParams = field(default_factory=StudyParams)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    feature_names: dict[str, list[str]] = field(default_factory=dict)
    folds: dict[str, FoldTable] = field(default_factory=dict)

    def prepare(self, bars: DataFrame, news: DataFrame,
                keywords: Mapping[str, Sequence[str]] | None = None,
                match: str = "substring") -> "Study":
        """Bars with target and technical features; news deduplicated, tagged (if untagged) and aligned."""
        bars = materialize(bars, "bars")
        clean = dedupe_news(news)
        if "Ticker" not in news.columns:
            tag: Column = tag_entity("Headlines", "Description", keywords, match)
            clean = clean.withColumn("Ticker", tag).filter(F.col("Ticker").isNotNull())
        technical = technical_table(add_target(bars))
        self.tables |= {"bars": bars, "technical": materialize(technical, "technical"),
                        "aligned": align_news(clean, bars)}
        return self

    def score(self, scorer: Scorer) -> "Study":
        """Scored news, reduced to what the later steps read, and flat daily sentiment."""
        scored = with_normalized_time(scorer(self.tables["aligned"]))
        kept = scored.select("Ticker", "Date", "Time", "normalized_time", "negative", "neutral",
                             "positive", "sentiment_score")
        self.tables["scored"] = materialize(kept, "scored")
        self.tables["daily"] = daily_sentiment(self.tables["scored"])
        return self

    def sweep(self, model: str = "boosted_trees") -> "Study":
        """All decay configurations judged by one model; the best one becomes the decay of the study."""
        p = self.params
        daily = sw.sweep_daily(self.tables["scored"], p.sweep)
        predictions = materialize(sw.sweep_predictions(self.tables["technical"], daily, p.sweep, p.folds, model),
                                  "sweep_predictions")
        metrics = materialize(sw.sweep_metrics(predictions, p.sweep, p.trading), "sweep_metrics")
        curve = sw.sweep_curve(metrics, p.metric)
        best = sw.best_config(curve)
        self.tables |= {"grid_summary": sw.grid_summary(predictions, p.sweep), "curve": curve,
                        "best_config": best}
        row = best.first()
        if row is not None and row.decay_type is not None:
            self.params = replace(p, decay_type=row.decay_type, decay_value=row.param_value)
        return self

    def features(self, variant: str) -> DataFrame:
        """Feature table of one variant."""
        technical, kind = self.tables["technical"], VARIANTS[variant]
        if kind is None:
            return technical
        daily = self.tables["daily"] if kind == "flat" else apply_decay(
            self.tables["scored"], self.params.decay_type, self.params.decay_value)
        return with_sentiment(technical, daily, kind)

    def train(self, variants: Sequence[str] = tuple(VARIANTS),
              models: Sequence[str] = tuple(MODELS)) -> "Study":
        """Out-of-fold predictions of every variant and model in one table.

        The baseline sees technical features only. The training tables of all
        variants are united, so that one run of a model covers all of them.
        """
        parts = []
        for v in variants:
            table = self.features(v)
            names = feature_names(table.columns, VARIANTS[v] is not None)
            self.folds[v] = fold_table(table, names, self.params.folds, variant=v)
            self.feature_names[v] = names
            parts.append(self.folds[v])
        rows = united(parts)
        predictions = reduce(DataFrame.unionByName, [MODELS[m](rows) for m in models])
        self.tables["predictions"] = materialize(predictions, "predictions")
        return self

    def evaluate(self) -> "Study":
        """One row of fold-averaged metrics per variant and model, and the findings."""
        comparison = rep.variant_names(compare(self.tables["predictions"], ("variant", "model_type"),
                                               self.params.trading))
        self.tables["comparison"] = materialize(comparison, "comparison")
        self.tables["findings"] = rep.key_findings(self.tables["comparison"])
        return self

    def explain(self, baseline: str = "baseline", other: str = "decay_sentiment") -> "Study":
        """Mean absolute attribution of the logistic models over all test rows of all folds, side by side."""
        shares = {}
        for v in (baseline, other):
            table = self.folds[v]
            fitted = fit_fold_logistic(table.rows, table.scales)
            parts = fitted_attribution(table.of(TEST), fitted, self.feature_names[v])
            shares[v] = materialize(parts.groupBy("feature").agg(F.avg("importance").alias("importance")), "importance")
        self.tables |= {"importance": compare_importance(shares[baseline], shares[other]),
                        "top_features": top_features(shares[other])}
        return self

    def explain_trees(self, baseline: str = "baseline", other: str = "decay_sentiment") -> "Study":
        """Mean absolute exact attribution of the boosted trees, side by side, and the share of their gain."""
        shares = {}
        for v in (baseline, other):
            table, names = self.folds[v], self.feature_names[v]
            rows = binned(table)
            fitted = fit_boosted(table, rows=rows)
            parts = tree_attribution(tree_contributions(table, fitted, rows), names)
            shares[v] = materialize(parts.groupBy("feature").agg(F.avg("importance").alias("importance")), "importance")
        gains = boosted_importance(fitted, names).groupBy("feature").agg(F.avg("importance").alias("importance"))
        self.tables |= {"tree_attribution": compare_importance(shares[baseline], shares[other]), "tree_importance": gains}
        return self

    def run(self, scorer: Scorer, skip: Sequence[str] = ()) -> "Study":
        """All steps after ``prepare``; ``skip`` names steps to leave out, such as sweep or explain."""
        steps = {"score": lambda: self.score(scorer), "sweep": self.sweep, "train": self.train,
                 "evaluate": self.evaluate, "explain": self.explain}
        unknown = set(skip) - set(steps)
        if unknown:
            raise ValueError(f"no such steps: {sorted(unknown)}")
        for name, step in steps.items():
            if name not in skip:
                step()
        return self

    def report(self, folder: str, fmt: str = "csv") -> list[str]:
        """Write the report tables."""
        tables = {n: self.tables.get(n) for n in
                  ("comparison", "grid_summary", "curve", "best_config", "findings", "importance",
                   "top_features", "tree_attribution", "tree_importance")}
        if "comparison" in self.tables:
            tables["metrics"] = rep.compared_metrics(self.tables["comparison"])
        if "scored" in self.tables:
            tables["profile"] = rep.score_profile(self.tables["scored"])
            tables["histogram"] = rep.score_histogram(self.tables["scored"])
            tables["boxplot"] = rep.score_boxplot(self.tables["scored"])
        return rep.write_report(tables, folder, fmt=fmt)
