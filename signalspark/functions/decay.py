"""Decay weights.

An intraday decay is anything with ``weight(t) -> Column`` where ``t`` is the
normalised time; the newest item (t = 1) has elapsed time 0. User-defined
decays only need that one method, and a plain callable works too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column
from pyspark.sql import functions as F


@runtime_checkable
class IntradayDecay(Protocol):
    def weight(self, t: Column) -> Column: ...


@dataclass(frozen=True)
class ExponentialDecay:
    """exp(-rate * elapsed)."""

    rate: float

    def weight(self, t: Column) -> Column:
        return F.exp(F.lit(-float(self.rate)) * (F.lit(1.0) - t))


@dataclass(frozen=True)
class LinearDecay:
    """1 - slope * elapsed, kept inside [0, 1]."""

    slope: float

    def weight(self, t: Column) -> Column:
        raw = F.lit(1.0) - F.lit(float(self.slope)) * (F.lit(1.0) - t)
        return F.when(t.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


@dataclass(frozen=True)
class HalfLifeDecay:
    """Cross-day memory with a half-life in calendar days."""

    days: float

    @property
    def alpha(self) -> float:
        """Share of the newest day in the memory."""
        return 1.0 - self.keep

    @property
    def keep(self) -> float:
        """Share of the memory kept over one calendar day."""
        return math.exp(math.log(0.5) / self.days)


def weight_column(decay: IntradayDecay | Callable[[Column], Column], t: Column) -> Column:
    """Weight of ``decay`` at ``t`` for a decay object or a plain function."""
    return decay.weight(t) if isinstance(decay, IntradayDecay) else decay(t)


def make_decay(kind: str, value: float) -> ExponentialDecay | LinearDecay | HalfLifeDecay:
    """Decay object for a type name and its parameter."""
    makers = {"exponential": ExponentialDecay, "linear": LinearDecay, "half_life": HalfLifeDecay}
    if kind not in makers:
        raise ValueError(f"Unknown decay type: {kind}")
    return makers[kind](float(value))
