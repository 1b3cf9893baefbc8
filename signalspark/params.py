"""Default parameters of the analysis, kept as plain dataclasses.

A caller changes a default with ``dataclasses.replace`` and passes the object to
the plan functions; nothing is read from files or the environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The parameter grids that the sweep covers by default.
EXPONENTIAL_RATES = (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
HALF_LIFE_DAYS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0, 14.0, 21.0)
LINEAR_SLOPES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

# Name of the single parameter of each decay type.
PARAM_NAMES = {"exponential": "lambda", "half_life": "half_life_days", "linear": "beta"}


@dataclass(frozen=True)
class FoldParams:
    """Rolling cross-validation, counted in distinct trading days."""

    train_days: int = 240
    test_days: int = 24
    folds: int = 10


@dataclass(frozen=True)
class TradingParams:
    """Cost per unit of position change, yearly risk-free rate, periods per year."""

    cost: float = 0.001
    risk_free: float = 0.02
    periods_per_year: int = 252


@dataclass(frozen=True)
class SweepParams:
    """The decay configurations of one sweep."""

    exponential: tuple[float, ...] = EXPONENTIAL_RATES
    half_life: tuple[float, ...] = HALF_LIFE_DAYS
    linear: tuple[float, ...] = LINEAR_SLOPES

    def configs(self) -> list[tuple[int, str, str, float]]:
        """(config_id, decay_type, param_name, param_value), numbered from 0."""
        pairs = [("exponential", v) for v in self.exponential]
        pairs += [("half_life", v) for v in self.half_life]
        pairs += [("linear", v) for v in self.linear]
        return [(i, kind, PARAM_NAMES[kind], float(v)) for i, (kind, v) in enumerate(pairs)]


@dataclass(frozen=True)
class StudyParams:
    """Everything one full study needs."""

    folds: FoldParams = field(default_factory=FoldParams)
    trading: TradingParams = field(default_factory=TradingParams)
    sweep: SweepParams = field(default_factory=SweepParams)
    metric: str = "sharpe_ratio"
    decay_type: str = "exponential"
    decay_value: float = 1.0
