"""Clock time mapped onto the trading session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session open and close in hours.
SESSION_OPEN = 9.5
SESSION_CLOSE = 16.0


def normalized_time(time: Column | str, rolled: Column | None = None,
                    off_calendar_t: float | None = None) -> Column:
    """Position of ``time`` in the session, 0 at the open and 1 at the close.

    Minutes count, seconds do not; times outside the session are clipped. News
    that was rolled to a later trading day keeps its own clock time unless
    ``off_calendar_t`` gives the value to use for rows where ``rolled`` is true.
    """
    time = F.col(time) if isinstance(time, str) else time
    hours = F.hour(time) + F.minute(time) / F.lit(60.0)
    share = (hours - F.lit(SESSION_OPEN)) / F.lit(SESSION_CLOSE - SESSION_OPEN)
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    # least/greatest skip nulls, so a missing time must be restored by hand
    clipped = F.when(time.isNotNull(), clipped)
    if off_calendar_t is None or rolled is None:
        return clipped
    return F.when(rolled, F.lit(float(off_calendar_t))).otherwise(clipped)
