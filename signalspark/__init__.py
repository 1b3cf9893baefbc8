"""Event-signal analytics on Spark: news scores, time decay, features, folds, metrics."""

from signalspark.functions.decay import ExponentialDecay, HalfLifeDecay, LinearDecay
from signalspark.operators.align import align_news
from signalspark.operators.daily import (
    apply_decay, daily_sentiment, decay_daily, half_life_memory, intraday_sentiment)
from signalspark.params import FoldParams, StudyParams, SweepParams, TradingParams
from signalspark.plans.study import Study

__all__ = [
    "ExponentialDecay", "FoldParams", "HalfLifeDecay", "LinearDecay", "Study", "StudyParams",
    "SweepParams", "TradingParams", "align_news", "apply_decay", "daily_sentiment",
    "decay_daily", "half_life_memory", "intraday_sentiment",
]
