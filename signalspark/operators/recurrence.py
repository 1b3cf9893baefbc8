"""First-order linear recurrences as windows.

``y_0 = x_0,  y_i = a x_i + q^(p_i - p_{i-1}) y_{i-1}`` has the closed form
``y_i = sum_j c_j x_j q^(p_i - p_j)`` with ``c_0 = 1`` and ``c_j = a``. A running
sum of ``x_j q^(-p_j)`` overflows on long series, so positions are cut into
blocks and each block uses exponents counted from its own start; one carry from
the block before is enough, because older rows have decayed below the precision
of a double. The windows see daily rows, of which an entity has at most one per
calendar day.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Exponents inside a block stay below 2^900; a block must outlast the slowest
# series by this many half-lives for a single carry to be exact in a double.
BLOCK_HALF_LIVES = 900
CARRY_HALF_LIVES = 60

Spec = tuple[Column, "Column | float", "Column | float"]


def decaying_sum(df: DataFrame, specs: Mapping[str, Spec], position: Column,
                 keys: Sequence[str]) -> DataFrame:
    """Add one column per entry ``name: (x, a, q)``.

    ``position`` is the integer order of a row inside its key group and must be
    unique there. Rows before the first non-null ``x`` stay null. Constant rates
    close enough to one another share their blocks, hence their sorts.
    """
    rates = [q for _, _, q in specs.values()]
    if len(specs) > 1 and (any(isinstance(q, Column) for q in rates) or not _shareable(rates)):
        for name, spec in specs.items():
            df = decaying_sum(df, {name: spec}, position, keys)
        return df
    group = Window.partitionBy(*keys)
    out = df.withColumn("_p", position.cast("long"))
    firsts = {n: F.min(F.when(x.isNotNull(), F.col("_p"))).over(group)
              for n, (x, _, _) in specs.items()}
    out = out.withColumns({f"_first_{n}": f for n, f in firsts.items()})
    out = out.withColumn("_start", F.min("_p").over(group))
    width = _width(rates)
    out = out.withColumns({"_o": F.col("_p") - F.col("_start"), "_width": width})
    out = out.withColumn("_block", F.floor(F.col("_o") / F.col("_width")).cast("long"))
    out = out.withColumn("_e", F.col("_o") - F.col("_block") * F.col("_width"))
    running = (Window.partitionBy(*keys, "_block").orderBy("_p")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = {}
    for name, (x, a, q) in specs.items():
        share = F.when(F.col("_p") == F.col(f"_first_{name}"), F.lit(1.0)).otherwise(_lit(a))
        term = share * x * F.pow(_lit(q), -F.col("_e"))
        local[f"_local_{name}"] = (F.coalesce(F.sum(term).over(running), F.lit(0.0))
                                   * F.pow(_lit(q), F.col("_e")))
    out = out.withColumns(local)
    one_before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    out = out.withColumn("_carry", F.max(F.struct("_o", *local)).over(one_before))
    gap = F.col("_o") - F.col("_carry._o")
    total = {}
    for name, (_, _, q) in specs.items():
        carried = F.pow(_lit(q), gap) * F.col(f"_carry._local_{name}")
        value = F.col(f"_local_{name}") + F.coalesce(carried, F.lit(0.0))
        total[name] = F.when(F.col("_p") >= F.col(f"_first_{name}"), value)
    out = out.withColumns(total)
    return out.select(*[c for c in df.columns if c not in specs], *specs)


def _lit(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _half_life(q: float) -> float:
    return math.log(0.5) / math.log(q)


def _shareable(rates: Sequence[float]) -> bool:
    lives = [_half_life(q) for q in rates]
    return BLOCK_HALF_LIVES * min(lives) >= CARRY_HALF_LIVES * max(lives)


def _width(rates: Sequence[Column | float]) -> Column:
    if len(rates) == 1 and isinstance(rates[0], Column):
        life = F.lit(math.log(0.5)) / F.ln(rates[0])
        return F.greatest(F.lit(1), F.floor(F.lit(BLOCK_HALF_LIVES) * life)).cast("long")
    return F.lit(max(1, int(BLOCK_HALF_LIVES * min(_half_life(q) for q in rates)))).cast("long")
