"""One Spark query per operator. Results are rounded so that they compare with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.functions.clock import normalized_time
from signalspark.functions.decay import ExponentialDecay, HalfLifeDecay, LinearDecay
from signalspark.functions.text import clean_text, score_from_probs, softmax, tag_entity, text_key, upper_each
from signalspark.operators import attribution, boosting, features as feat, indicators as ind, metrics
from signalspark.operators import models as mod
from signalspark.operators import scoring, tree_shap
from signalspark.operators.align import align_news
from signalspark.operators.daily import (
    daily_mean, daily_sentiment, decay_daily, half_life_memory, intraday_sentiment,
    weighted_variance, with_normalized_time)
from signalspark.operators.fold_table import FoldTable, fold_table
from signalspark.operators.folds import TEST, TRAIN, assign_folds, fold_days
from signalspark.operators.logistic import fit_fold_logistic, predict_logistic
from signalspark.operators.ordered import auc
from signalspark.operators.tagging import tag_by_dictionary, tag_by_substring
from signalspark.params import SweepParams
from signalspark.plans import report, sweep
from signalspark.plans.study import Study
from signalspark.sources.market import standardize_bars, trading_days, union_bars
from signalspark.sources.news import dedupe_news
from signalspark.storage import materialize, work_dir
from signalspark.streaming.decay import DecayStore, memory_state, merge_states, newest_memory
from workload import views as v

Query = Callable[[SparkSession, str], DataFrame]

# Digits kept of a column, and of the smoothed prices, whose sums are long.
DIGITS, SMOOTHED_DIGITS = 9, 4
SMOOTHED = frozenset(("EMA_12", "EMA_26", "MACD", "MACD_signal", "MACD_diff", "RSI"))
# Feature columns of the matrices that stay small enough to write in SQL.
FEATURES = ("return_1d", "return_5d", "return_10d", "volatility")
KEYS = ("variant", "model_type")
FOLD_KEYS = (*KEYS, "fold")


def rounded(df: DataFrame) -> DataFrame:
    """Round the doubles: smoothed prices to 4 digits, everything else to 9."""
    return df.select(*[
        F.round(c, SMOOTHED_DIGITS if c in SMOOTHED else DIGITS).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes])


def _bars_with(add: Callable[[DataFrame], DataFrame], columns: Sequence[str]) -> Query:
    """Query: an indicator over the bars."""
    return lambda s, d: rounded(add(v.bars(s, d)).select("Ticker", "Date", *columns))


def _features(kind: str | None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        if kind is None:
            df = feat.add_target(v.bars(s, d))
        else:
            df = v.market_flat(s, d) if kind == "flat" else v.market_decay(s, d)
        out = feat.prepare_features(df, kind)
        names = feat.feature_names(out.columns, kind is not None)
        return rounded(out.select("Ticker", "Date", "Target", *names))
    return run


# --- sources and sinks ---


def market_bars(s: SparkSession, d: str) -> DataFrame:
    return rounded(standardize_bars(v.bars(s, d)))


def market_union(s: SparkSession, d: str) -> DataFrame:
    return rounded(standardize_bars(union_bars([v.bars(s, d), v.event_bars(s, d)])))


def news_dedup(s: SparkSession, d: str) -> DataFrame:
    return dedupe_news(v.news(s, d).select("Headlines", "Time", "Description"))


def trading_calendar(s: SparkSession, d: str) -> DataFrame:
    return trading_days(v.table(s, d, "lineitem").select(
        v.entity_of("l_suppkey").alias("Ticker"), F.to_date("l_shipdate").alias("Date")))


def score_increment(s: SparkSession, d: str) -> DataFrame:
    """Texts no labelled document has: those the labels' scorer has not seen."""
    docs = v.table(s, d, "documents").select("doc_id", F.col("text").alias("combined_text"))
    docs = docs.withColumn("text_key", text_key("combined_text"))
    scored = (docs.join(v.table(s, d, "labels").select("doc_id"), "doc_id", "left_semi")
              .select("text_key", F.lit("v1").alias("model_version")))
    return scoring.pending_texts(docs, scored, "v1").select("text_key")


# --- text ---


def tag_entity_query(s: SparkSession, d: str) -> DataFrame:
    docs = v.document_news(s, d)
    tagged = docs.select(
        "doc_id", tag_entity("Headlines", "Description", v.KEYWORDS).alias("by_substring"),
        tag_entity("Headlines", "Description", v.KEYWORDS, match="word").alias("by_word"))
    return tagged.filter(F.col("by_substring").isNotNull())


def tag_dictionary(s: SparkSession, d: str) -> DataFrame:
    """Tags by joining the words of the documents with a dictionary table."""
    pairs = [(w, t) for t, words in v.KEYWORDS.items() for w in words]
    rows = [(w, i, t) for i, (w, t) in enumerate(pairs)]
    dictionary = s.createDataFrame(rows, "word string, rank int, Ticker string")
    return tag_by_dictionary(v.document_news(s, d), dictionary, "doc_id").select("doc_id", "Ticker")


def tag_substring(s: SparkSession, d: str) -> DataFrame:
    """Tags by the long words of the benchmark passages, found anywhere in the documents."""
    words = v.table(s, d, "benchmark").select(F.explode(F.split(upper_each("text"), r"[^\p{L}]+")).alias("word")).distinct()
    size, code = F.length("word"), F.conv(F.substring(F.md5("word"), 1, 6), 16, 10).cast("int")
    dictionary = words.filter(size >= 8).select("word", code.alias("rank"), F.concat(F.lit("E"), size).alias("Ticker"))
    return tag_by_substring(v.document_news(s, d), materialize(dictionary, "keywords"), "doc_id").select("doc_id", "Ticker")


def softmax_scores(s: SparkSession, d: str) -> DataFrame:
    """Class probabilities from logits of the documents that are far apart."""
    logits = F.array(F.col("n_chars") / 7, (F.col("doc_id") % 13) * 40.0, -F.length("source").cast("double"))
    docs = v.table(s, d, "documents").select("doc_id", softmax(logits).alias("p"))
    return rounded(docs.select("doc_id", *[F.col("p")[i].alias(c) for i, c in enumerate(scoring.CLASSES)]))


def clean_text_query(s: SparkSession, d: str) -> DataFrame:
    docs = scoring.with_text(v.document_news(s, d))
    return docs.select("doc_id", F.md5(clean_text("Description")).alias("text_md5"),
                       F.length("combined_text").cast("bigint").alias("combined_chars"), "text_key")


def score_lexicon(s: SparkSession, d: str) -> DataFrame:
    scored = scoring.score_lexicon(v.table(s, d, "documents"), "text", v.POSITIVE_WORDS,
                                   v.NEGATIVE_WORDS)
    return rounded(scored.select("doc_id", *scoring.CLASSES, "sentiment_score"))


def score_batch(s: SparkSession, d: str) -> DataFrame:
    predict = scoring.lexicon_predict_fn(v.POSITIVE_WORDS, v.NEGATIVE_WORDS)
    scored = scoring.score_texts(v.document_news(s, d), predict, salt_by=["doc_id"])
    return rounded(scored.select("doc_id", *scoring.CLASSES, "sentiment_score"))


def score_budget(s: SparkSession, d: str) -> DataFrame:
    """``score_batch`` in batches of a bounded padded size."""
    predict = scoring.lexicon_predict_fn(v.POSITIVE_WORDS, v.NEGATIVE_WORDS)
    scored = scoring.score_texts(v.document_news(s, d), predict, salt_by=["doc_id"], budget=scoring.PADDED_CHARS)
    return rounded(scored.select("doc_id", *scoring.CLASSES, "sentiment_score"))


def score_model(s: SparkSession, d: str) -> DataFrame:
    model = scoring.text_classifier().fit(v.labelled_text(s, d))
    scored = scoring.score_classifier(model, v.table(s, d, "documents"))
    return rounded(scored.select("doc_id", *scoring.CLASSES, "sentiment_score"))


def score_from_probs_query(s: SparkSession, d: str) -> DataFrame:
    scored = v.scored_news(s, d)
    return rounded(scored.select("o_orderkey", score_from_probs("positive", "negative")
                                 .alias("sentiment_score")))


# --- alignment ---


def _aligned(roll: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        market = v.written_bars(s, d)
        aligned = align_news(v.news(s, d), market, roll, ["o_orderkey"])
        return rounded(aligned.select("o_orderkey", "Ticker", "Date", "Time", "Headlines",
                                      "Description", "Open", "High", "Low", "Close", "Volume"))
    return run


def target(s: SparkSession, d: str) -> DataFrame:
    return rounded(feat.add_target(v.bars(s, d)).select("Ticker", "Date", "Target", "fwd_return"))


def target_distribution(s: SparkSession, d: str) -> DataFrame:
    return report.target_distribution(feat.add_target(v.bars(s, d)))


def score_profile(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.score_profile(v.scored_events(s, d)))


def sentiment_coverage(s: SparkSession, d: str) -> DataFrame:
    return report.sentiment_coverage(v.market_flat(s, d))


def normalized_time_query(s: SparkSession, d: str) -> DataFrame:
    events = v.table(s, d, "events")
    return rounded(events.select("event_id", normalized_time("ts").alias("normalized_time")))


def market_sentiment_join(s: SparkSession, d: str) -> DataFrame:
    out = v.market_flat(s, d)
    return rounded(out.select("Ticker", "Date", "Target", "sent_mean", "sent_std", "sent_min",
                              "sent_max", "sent_count"))


# --- daily aggregates and decay ---


def daily_sentiment_query(s: SparkSession, d: str) -> DataFrame:
    return rounded(daily_sentiment(v.aligned_news(s, d, v.written_bars(s, d))))


def intraday_sentiment_query(s: SparkSession, d: str) -> DataFrame:
    return rounded(intraday_sentiment(v.aligned_events(s, d)))


def _decayed(decay) -> Query:
    return lambda s, d: rounded(decay_daily(v.aligned_events(s, d), decay).drop("sent_decay_var"))


def decay_increment(s: SparkSession, d: str) -> DataFrame:
    """The exponential decay from a store that took the news in three batches, none of them in order of days."""
    scored = v.aligned_events(s, d)
    store = DecayStore(s, f"{work_dir(s)}/decay-{uuid.uuid4().hex}", fold_after=1)
    for batch in range(3):
        store.add(scored.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == batch), batch)
    rate = SweepParams(exponential=(1.0,), half_life=(), linear=())
    return rounded(store.features(rate).drop("config_id", "sent_decay_var"))


def memory_increment(s: SparkSession, d: str) -> DataFrame:
    """Newest half-life memory of each entity, merged from the states of odd and even days."""
    daily = daily_mean(v.aligned_news(s, d, v.written_bars(s, d)))
    decay = HalfLifeDecay(3.0)
    halves = [memory_state(daily.filter(F.day("Date") % 2 == k), decay, k) for k in (0, 1)]
    return rounded(newest_memory(merge_states(halves[0].unionByName(halves[1]), decay), decay))


def squared_decay(t):
    """A user-defined decay: the square of the position in the session."""
    return t * t


def decay_variance(s: SparkSession, d: str) -> DataFrame:
    return rounded(weighted_variance(v.aligned_events(s, d), LinearDecay(0.8)))


def half_life_memory_query(s: SparkSession, d: str) -> DataFrame:
    scored = v.aligned_news(s, d, v.written_bars(s, d))
    return rounded(half_life_memory(daily_mean(scored), HalfLifeDecay(3.0)))


# --- features ---


def _sentiment_step(add: Callable[[DataFrame], DataFrame], columns: Sequence[str]) -> Query:
    return lambda s, d: rounded(add(v.market_flat(s, d)).select("Ticker", "Date", *columns))


def sentiment_features(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = v.market_flat(s, d) if kind == "flat" else v.market_decay(s, d)
        out = feat.add_sentiment_features(df.drop("fwd_return"), kind)
        made = [c for c in out.columns if c not in df.columns]
        return rounded(out.select("Ticker", "Date", *made))
    return run


def feature_fill(s: SparkSession, d: str) -> DataFrame:
    df = ind.add_momentum(v.market_flat(s, d))
    columns = ("sent_mean", "sent_std", "sent_count", "positive_mean", "Momentum")
    return rounded(feat.fill_features(df.select("Ticker", "Date", *columns)))


def model_matrix(s: SparkSession, d: str) -> DataFrame:
    df = feat.add_target(ind.add_returns(v.bars(s, d)))
    names = [f"log_return_{n}d" for n in ind.RETURN_PERIODS]
    return rounded(feat.model_matrix(df, names).select("Ticker", "Date", "Target", *names))


# --- folds ---


def rolling_folds(s: SparkSession, d: str) -> DataFrame:
    return fold_days(v.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("Date")))


def _technical_rows(s: SparkSession, d: str) -> DataFrame:
    """Returns and volatility with target, complete rows only, as a written table."""
    df = feat.add_target(ind.add_volatility(ind.add_returns(v.bars(s, d))))
    rows = feat.model_matrix(df, FEATURES).select("Ticker", "Date", "Target", "fwd_return", *FEATURES)
    return materialize(rows, "technical_rows")


def fold_standardize(s: SparkSession, d: str) -> DataFrame:
    scaled = mod.fold_rows(_technical_rows(s, d), FEATURES)
    return rounded(scaled.select("fold", "role", "Ticker", "Date", *[F.col("x")[i].alias(c) for i, c in enumerate(FEATURES)]))


# --- metrics over the rule predictions ---


def _written_predictions(s: SparkSession, d: str) -> DataFrame:
    """The rule predictions as a written table, for metrics that read them more than once."""
    return materialize(v.rule_predictions(s, d), "rule_predictions")


def classification_metrics(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.classification_metrics(_written_predictions(s, d), FOLD_KEYS))


def auc_rank(s: SparkSession, d: str) -> DataFrame:
    return rounded(auc(v.rule_predictions(s, d), KEYS))


def cv_metrics(s: SparkSession, d: str) -> DataFrame:
    by_fold = metrics.classification_metrics(_written_predictions(s, d), FOLD_KEYS)
    return rounded(metrics.over_folds(by_fold, KEYS, metrics.CLASSIFICATION))


def strategy_returns(s: SparkSession, d: str) -> DataFrame:
    out = metrics.strategy_returns(v.rule_predictions(s, d), FOLD_KEYS)
    return rounded(out.select(*FOLD_KEYS, "Ticker", "Date", "position", "cost", "net_return"))


def _portfolio(s: SparkSession, d: str) -> DataFrame:
    paths = metrics.strategy_returns(v.rule_predictions(s, d), FOLD_KEYS)
    return metrics.portfolio_returns(paths, FOLD_KEYS)


def equity_curve(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.equity_curve(_portfolio(s, d), FOLD_KEYS))


def drawdown(s: SparkSession, d: str) -> DataFrame:
    curve = metrics.equity_curve(_portfolio(s, d), FOLD_KEYS)
    return rounded(metrics.drawdown(curve, FOLD_KEYS).drop("net_return"))


def sharpe(s: SparkSession, d: str) -> DataFrame:
    daily = _portfolio(s, d)
    return rounded(daily.groupBy(*FOLD_KEYS).agg(metrics.sharpe_ratio().alias("sharpe_ratio")))


def trading_metrics(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.trading_metrics(_portfolio(s, d), FOLD_KEYS))


def trading_metrics_cv(s: SparkSession, d: str) -> DataFrame:
    by_fold = metrics.trading_metrics(_portfolio(s, d), FOLD_KEYS)
    return rounded(metrics.over_folds(by_fold, KEYS, metrics.TRADING))


def rule_comparison(s: SparkSession, d: str) -> DataFrame:
    """The comparison table of the fixed rules, with display names."""
    return report.variant_names(metrics.compare(_written_predictions(s, d)))


def key_findings(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.key_findings(rule_comparison(s, d)))


# --- sweep ---


def decay_grid(s: SparkSession, d: str) -> DataFrame:
    """Each configuration with the days it covers and its mean daily signal."""
    daily = sweep.sweep_daily(v.aligned_events(s, d))
    signal = F.coalesce("sent_decay_mean", "sentiment_memory")
    totals = daily.groupBy("config_id").agg(F.count(F.lit(1)).alias("days"),
                                            F.avg(signal).alias("mean_signal"))
    return rounded(F.broadcast(sweep.config_table(s)).join(totals, "config_id"))


def sweep_features(s: SparkSession, d: str) -> DataFrame:
    market = materialize(v.event_bars(s, d), "event_bars")
    scored = align_news(v.scored_events(s, d), market, salt_by=["event_id"])
    daily = sweep.sweep_daily(scored.select("Ticker", "Date", "Time", "sentiment_score"))
    return rounded(sweep.sweep_market(market.select("Ticker", "Date", "Close"), daily))


def _sweep_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Market with target, and the daily features of all configurations."""
    bars = v.written_bars(s, d)
    daily = sweep.sweep_daily(v.aligned_news(s, d, bars).select(
        "Ticker", "Date", "Time", "sentiment_score"))
    return feat.add_target(bars), daily


def grid_summary(s: SparkSession, d: str) -> DataFrame:
    market, daily = _sweep_tables(s, d)
    rows = sweep.sweep_market(market.select("Ticker", "Date"), daily)
    return sweep.grid_summary(assign_folds(rows, fold_days(market)))


def _signal_quality(s: SparkSession, d: str) -> DataFrame:
    """Correlation of each configuration's signal with the target."""
    market, daily = _sweep_tables(s, d)
    rows = sweep.sweep_market(market.select("Ticker", "Date", "Target"), daily)
    signal = F.coalesce("sent_decay_mean", "sentiment_memory")
    quality = rows.withColumn("signal", signal).filter(F.col("signal").isNotNull()).groupBy(
        "config_id").agg(metrics.correlation(F.col("signal"), F.col("Target").cast("double")).alias("metric_value"))
    return F.broadcast(sweep.config_table(s)).join(quality, "config_id")


def best_config(s: SparkSession, d: str) -> DataFrame:
    return rounded(sweep.best_config(_signal_quality(s, d)))


def _sweep_metrics(s: SparkSession, d: str, model: str = "logistic_regression") -> DataFrame:
    market, daily = _sweep_tables(s, d)
    technical = materialize(feat.technical_table(market), "technical")
    predictions = sweep.sweep_predictions(technical, daily, model=model)
    return sweep.sweep_metrics(materialize(predictions, "sweep_predictions"))


def sweep_cv(s: SparkSession, d: str) -> DataFrame:
    return rounded(_sweep_metrics(s, d))


def sweep_boosted(s: SparkSession, d: str) -> DataFrame:
    """The sweep judged by boosted trees, its default: a model per configuration and fold."""
    return rounded(_sweep_metrics(s, d, "boosted_trees"))


def sweep_curve(s: SparkSession, d: str) -> DataFrame:
    return rounded(sweep.sweep_curve(_sweep_metrics(s, d)))


# --- models ---


def cv_logistic(s: SparkSession, d: str) -> DataFrame:
    return rounded(mod.cv_logistic(_technical_rows(s, d), FEATURES))


def cv_logistic_keys(s: SparkSession, d: str) -> DataFrame:
    """What the data alone determine of ``cv_logistic``: which rows are predicted in which fold, and their truth."""
    out = mod.cv_logistic(_technical_rows(s, d), FEATURES)
    sound = (F.col("proba").between(0, 1) & ((F.col("proba") > 0.5) == (F.col("y_pred") == 1))).cast("int")
    return out.select("fold", "Ticker", "Date", "y_true", sound.alias("sound"))


def logistic_gradient(s: SparkSession, d: str) -> DataFrame:
    """Optimality of every fold's logistic fit: training rows, and the largest gradient component, which is 0."""
    table = fold_table(_technical_rows(s, d), FEATURES)
    fitted = fit_fold_logistic(table.rows, table.scales)
    scored = predict_logistic(table.of(TRAIN), fitted).select("model", "fold", (F.col("proba") - F.col("y")).alias("miss"),
                                                   F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("at", "value"))
    sums = scored.groupBy("model", "fold", "at").agg(F.sum(F.col("miss") * F.col("value")).alias("g"), F.count(F.lit(1)).alias("n"))
    beta = F.concat("coef", F.array(F.lit(0.0)))  # the intercept has no penalty
    at = sums.join(F.broadcast(fitted.select("model", beta.alias("beta"))), "model")  # one row per fold
    g = F.abs(F.col("g") + F.element_at("beta", F.col("at") + 1))
    return at.groupBy("fold").agg(F.max("n").alias("n_train"), F.round(F.max(g), 4).alias("gradient"))


def score_model_totals(s: SparkSession, d: str) -> DataFrame:
    """Every document once, with the sum of its class probabilities by the trained scorer."""
    model = scoring.text_classifier().fit(v.labelled_text(s, d))
    scored = scoring.score_classifier(model, v.table(s, d, "documents"))
    return scored.select("doc_id", F.round(sum(F.col(c) for c in scoring.CLASSES), 6).alias("total"))


def cv_gbt(s: SparkSession, d: str) -> DataFrame:
    return rounded(mod.cv_boosted(_technical_rows(s, d), FEATURES))


def model_importance(s: SparkSession, d: str) -> DataFrame:
    table = fold_table(_technical_rows(s, d), FEATURES)
    return rounded(mod.coefficient_importance(fit_fold_logistic(table.rows, table.scales), FEATURES))


def model_attribution(s: SparkSession, d: str) -> DataFrame:
    """Attribution of every fold's logistic model over its test rows."""
    table = fold_table(_technical_rows(s, d), FEATURES)
    fitted = fit_fold_logistic(table.rows, table.scales)
    return rounded(attribution.fitted_attribution(table.of(TEST), fitted, FEATURES))


def _boosted(s: SparkSession, d: str) -> tuple[FoldTable, DataFrame, DataFrame]:
    """Training table, fitted trees and binned rows of the technical features."""
    table = fold_table(_technical_rows(s, d), FEATURES)
    rows = boosting.binned(table)
    return table, boosting.fit_boosted(table, rows=rows), rows


def boosted_importance(s: SparkSession, d: str) -> DataFrame:
    return rounded(boosting.boosted_importance(_boosted(s, d)[1], FEATURES))


def tree_attribution_query(s: SparkSession, d: str) -> DataFrame:
    """Exact attribution of every fold's boosted trees over its test rows."""
    return rounded(tree_shap.tree_attribution(tree_shap.tree_contributions(*_boosted(s, d)), FEATURES))


def tree_attribution_sums(s: SparkSession, d: str) -> DataFrame:
    """What the data alone determine of the attributions: each test row, whose contributions add up to its margin."""
    parts = tree_shap.tree_contributions(*_boosted(s, d))
    total = F.aggregate("phi", F.col("base"), lambda a, v: a + v)
    sound = (F.abs(total - F.col("margin")) < 1e-9).cast("int")
    return parts.select("fold", "Ticker", "Date", F.size("phi").alias("n_features"), sound.alias("sound"))


def cv_gbt_keys(s: SparkSession, d: str) -> DataFrame:
    """Rows that the boosted trees predict in each fold, and their truth."""
    out = mod.cv_boosted(_technical_rows(s, d), FEATURES)
    sound = (F.col("proba").between(0, 1) & ((F.col("proba") > 0.5) == (F.col("y_pred") == 1))).cast("int")
    return out.select("fold", "Ticker", "Date", "y_true", sound.alias("sound"))


def variant_comparison(s: SparkSession, d: str) -> DataFrame:
    study = _study(s, d, v.news)
    return rounded(study.train().evaluate().tables["comparison"])


def _study(s: SparkSession, d: str, news: Callable[[SparkSession, str], DataFrame]) -> Study:
    """A study on priority-scored orders or lexicon-scored documents."""
    study = Study().prepare(v.bars(s, d), news(s, d), v.KEYWORDS, match="word")
    if news is v.document_news:
        return study.score(lambda df: scoring.score_lexicon(
            scoring.with_text(df), "combined_text", v.POSITIVE_WORDS, v.NEGATIVE_WORDS))
    return study.score(lambda df: scoring.with_score(v.priority_shares(df)))


def end_to_end(s: SparkSession, d: str) -> DataFrame:
    """Documents to findings: dedupe, tag, align, score, sweep, train, evaluate."""
    study = _study(s, d, v.document_news)
    return rounded(study.sweep().train().evaluate().tables["comparison"])


# --- attribution and report ---


def _slopes(rows: DataFrame, names: Sequence[str]) -> list:
    """Least-squares slope of the target on each feature alone."""
    y = F.col("Target").cast("double")
    return [F.regr_slope(y, F.col(c)).alias(c) for c in names]


def linear_attribution(s: SparkSession, d: str) -> DataFrame:
    """Mean absolute contribution of each feature under its own least-squares slope."""
    rows = _technical_rows(s, d)
    fitted = rows.agg(*_slopes(rows, [*FEATURES]), *[F.avg(c).alias(f"{c}_mean") for c in FEATURES])
    model = fitted.first()  # one row: slope and mean per feature
    parts = attribution.linear_contributions(
        rows, {c: F.lit(model[c]) for c in FEATURES}, {c: F.lit(model[f"{c}_mean"]) for c in FEATURES})
    return rounded(attribution.mean_absolute(parts, FEATURES))


def _correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Importance of features: absolute correlation with the target."""
    y = F.col("Target").cast("double")
    row = df.agg(*[F.abs(metrics.correlation(F.col(c).cast("double"), y)).alias(c) for c in names])
    return row.unpivot([], list(names), "feature", "importance")


def _importances(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    table = materialize(feat.fill_features(ind.add_momentum(ind.add_returns(v.market_flat(s, d)))),
                        "importance_rows")
    technical = ("Momentum", "return_1d", "return_5d", "return_10d")
    sentiment = ("Momentum", "return_1d", "sent_mean", "sent_std", "sent_min", "sent_max",
                 "sent_count")
    return _correlations(table, technical), _correlations(table, sentiment)


def importance_compare(s: SparkSession, d: str) -> DataFrame:
    return rounded(attribution.compare_importance(*_importances(s, d)))


def top_features(s: SparkSession, d: str) -> DataFrame:
    baseline, sentiment = _importances(s, d)
    only = sentiment.join(baseline.select("feature"), "feature", "left_anti")
    return rounded(attribution.top_features(baseline.unionByName(only), 5))


#: Rows that the sampling attribution explains, and rows it compares with, per fold.
SHAPLEY_ROWS = 100


def sampled_shapley(s: SparkSession, d: str) -> DataFrame:
    """Shapley values of every fold's boosted trees on rows sampled per fold (the method's sample)."""
    rows = mod.fold_rows(_technical_rows(s, d), FEATURES)
    # all samples in one job
    picked = materialize(attribution.sample_per_group(rows, ["model", "role"], SHAPLEY_ROWS, ["Ticker", "Date"]), "samples")
    parts = []
    for name, model in mod.fit_per_fold(rows, mod.boosted_trees).items():
        mine = picked.filter(F.col("model") == name)
        parts.append(attribution.sampled_shapley(model, mine.filter(F.col("role") == TEST), mine.filter(F.col("role") == TRAIN), FEATURES)
                     .withColumn("model", F.lit(name)))
    return rounded(reduce(DataFrame.unionByName, parts))


def score_histogram(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.score_histogram(v.scored_events(s, d)))


def score_boxplot(s: SparkSession, d: str) -> DataFrame:
    return rounded(report.score_boxplot(v.scored_events(s, d)))


QUERIES: dict[str, Query] = {
    "market_bars": market_bars,
    "market_union": market_union,
    "news_dedup": news_dedup,
    "trading_calendar": trading_calendar,
    "score_increment": score_increment,
    "tag_entity": tag_entity_query,
    "tag_dictionary": tag_dictionary,
    "tag_substring": tag_substring,
    "softmax": softmax_scores,
    "clean_text": clean_text_query,
    "target": target,
    "target_distribution": target_distribution,
    "score_profile": score_profile,
    "sentiment_coverage": sentiment_coverage,
    "normalized_time": normalized_time_query,
    "align_forward": _aligned("forward"),
    "align_exact": _aligned("exact"),
    "market_sentiment_join": market_sentiment_join,
    "daily_sentiment": daily_sentiment_query,
    "intraday_sentiment": intraday_sentiment_query,
    "decay_exponential": _decayed(ExponentialDecay(1.0)),
    "decay_linear": _decayed(LinearDecay(1.0)),
    "decay_custom": _decayed(squared_decay),
    "decay_increment": decay_increment,
    "memory_increment": memory_increment,
    "decay_variance": decay_variance,
    "half_life_memory": half_life_memory_query,
    "returns": _bars_with(ind.add_returns, [f"{p}return_{n}d" for n in (1, 5, 10)
                                            for p in ("", "log_")]),
    "volatility": _bars_with(ind.add_volatility, ["return_1d", "volatility"]),
    "rsi": _bars_with(ind.add_rsi, ["RSI"]),
    "macd": _bars_with(ind.add_macd, ["MACD", "MACD_signal", "MACD_diff"]),
    "ema": _bars_with(ind.add_ema, ["EMA_12", "EMA_26"]),
    "momentum": _bars_with(ind.add_momentum, ["Momentum"]),
    "technical_features": _bars_with(ind.add_all_indicators, [
        *[f"{p}return_{n}d" for n in (1, 5, 10) for p in ("", "log_")], "volatility", "Momentum",
        "EMA_12", "EMA_26", "RSI", "MACD", "MACD_signal", "MACD_diff"]),
    "sentiment_lags": _sentiment_step(
        lambda df: feat.add_lags(df, ["sent_mean", "sent_count"]),
        [f"{c}_lag{k}" for c in ("sent_mean", "sent_count") for k in (1, 2, 3)]),
    "sentiment_momentum": _sentiment_step(feat.add_sentiment_momentum, ["sent_momentum"]),
    "sentiment_volatility": _sentiment_step(feat.add_sentiment_volatility, ["sent_volatility"]),
    "sentiment_features_flat": sentiment_features("flat"),
    "sentiment_features_decay": sentiment_features("decay"),
    "feature_fill": feature_fill,
    "features_baseline": _features(None),
    "features_flat": _features("flat"),
    "features_decay": _features("decay"),
    "model_matrix": model_matrix,
    "rolling_folds": rolling_folds,
    "fold_standardize": fold_standardize,
    "classification_metrics": classification_metrics,
    "auc_rank": auc_rank,
    "cv_metrics": cv_metrics,
    "strategy_returns": strategy_returns,
    "equity_curve": equity_curve,
    "drawdown": drawdown,
    "sharpe": sharpe,
    "trading_metrics": trading_metrics,
    "trading_metrics_cv": trading_metrics_cv,
    "rule_comparison": lambda s, d: rounded(rule_comparison(s, d)),
    "key_findings": key_findings,
    "decay_grid": decay_grid,
    "sweep_features": sweep_features,
    "grid_summary": grid_summary,
    "best_config": best_config,
    "sweep_cv": sweep_cv,
    "sweep_boosted": sweep_boosted,
    "sweep_curve": sweep_curve,
    "score_from_probs": score_from_probs_query,
    "score_lexicon": score_lexicon,
    "score_batch": score_batch,
    "score_budget": score_budget,
    "score_model": score_model,
    "cv_logistic": cv_logistic,
    "cv_gbt": cv_gbt,
    "cv_logistic_keys": cv_logistic_keys,
    "cv_gbt_keys": cv_gbt_keys,
    "boosted_importance": boosted_importance,
    "tree_attribution": tree_attribution_query,
    "tree_attribution_sums": tree_attribution_sums,
    "logistic_gradient": logistic_gradient,
    "score_model_totals": score_model_totals,
    "model_importance": model_importance,
    "model_attribution": model_attribution,
    "variant_comparison": variant_comparison,
    "linear_attribution": linear_attribution,
    "importance_compare": importance_compare,
    "top_features": top_features,
    "sampled_shapley": sampled_shapley,
    "score_histogram": score_histogram,
    "score_boxplot": score_boxplot,
    "end_to_end": end_to_end,
}
