"""Exact quantiles per group (linear interpolation between closest ranks).

Same definition as Spark's ``percentile`` and SQL ``quantile_cont``: for a
group of ``n`` values and fraction ``q`` the position is ``q * (n - 1)``; the
result interpolates the values at ranks ``floor`` and ``ceil`` of it.

Nothing sorts a whole group. One plan for every size, two passes that each end in a
partial aggregation, so a hot group costs every task a state of bounded size:

1. values are counted per stretch; stretches are equally long on a logarithmic scale,
   ``PER_DOUBLING`` to a factor of two, so a value is known to 0.3 % from its stretch and
   values of ten magnitudes fall into under 9,000. A running sum over a group's stretches
   names the one or two that hold the wanted ranks, and how many values lie below;
2. the values of those stretches alone are counted per value, and a running sum over them
   finds the ranks. Of integers near ``v`` that are at most ``v / 370`` different values.

Which stretch a value is in depends on the value alone. A randomised sketch would bracket the
rank more tightly in fewer stretches, but Spark may compute an aggregate again, for another
branch of the plan or after a lost executor, and the second sketch need not agree with the
first. The group columns travel as one struct, so a NULL group is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_DOUBLING = 256
ABOVE = 1 << 20        # more than any stretch number: doubles span 2^-1075 to 2^1024


def percentile_exact(df: DataFrame, groups: Sequence[str], value: str, q: float, alias: str = "q",
                     extra: Sequence[Column] = ()) -> DataFrame:
    """``groups + [alias] + extra``: exact ``q``-quantile of ``value`` per group.

    ``value`` is an integer or floating column; NULL and NaN values are ignored and a
    group with no other has a NULL quantile. ``extra`` aggregates are computed per group
    beside it.
    """
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    v = F.col(value).cast("long" if whole else "double")
    v = v if whole else F.when(~F.isnan(v), v)
    key = F.struct(*groups).alias("_g")
    base = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *extra)
    names = [c for c in base.columns if c not in ("_g", "_rows")]

    values = df.select(key, v.alias("_v")).where(F.col("_v").isNotNull()).select("_g", "_v", _stretch(F.col("_v")).alias("_s"))
    counts = values.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_g").orderBy("_s")
    every = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pos = (F.sum("_c").over(every) - 1).cast("double") * F.lit(q)
    held = counts.select("_g", "_s", "_c", (F.sum("_c").over(upto) - F.col("_c")).alias("_below"), pos.alias("_pos"))
    held = held.withColumn("_lo", F.floor("_pos").cast("long")).withColumn("_hi", F.ceil("_pos").cast("long"))

    def holds(rank: Column) -> Column:
        return (F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_c"))

    wanted = held.where(holds(F.col("_lo")) | holds(F.col("_hi"))).drop("_c")
    few = values.join(wanted, ["_g", "_s"]).groupBy("_g", "_s", "_below", "_pos", "_lo", "_hi", "_v").agg(
        F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy("_g", "_s").orderBy("_v")
    ranked = few.withColumn("_cum", F.col("_below") + F.sum("_m").over(inside))  # values up to this one

    def at(rank: Column) -> Column:  # this distinct value holds 0-based ``rank``
        return F.when((F.col("_cum") - F.col("_m") <= rank) & (rank < F.col("_cum")), F.col("_v").cast("double"))

    found = ranked.groupBy("_g", "_pos", "_lo", "_hi").agg(F.max(at(F.col("_lo"))).alias("_lv"), F.max(at(F.col("_hi"))).alias("_hv"))
    interp = F.when(F.col("_hi") == F.col("_lo"), F.col("_lv")).otherwise(
        (F.col("_hi") - F.col("_pos")) * F.col("_lv") + (F.col("_pos") - F.col("_lo")) * F.col("_hv"))
    return base.select("_g", *names).join(found.select("_g", interp.alias(alias)), "_g", "left").select(
        *(F.col("_g")[g].alias(g) for g in groups), alias, *names)


def _stretch(v: Column) -> Column:
    """Number of the stretch a value lies in, in the order of the values (logarithms keep it)."""
    size = F.abs(v.cast("double"))
    at = F.floor(F.least(F.log2(size) * PER_DOUBLING, F.lit(float(ABOVE - 1)))).cast("int") + ABOVE
    return F.when(v > 0, at).when(v < 0, -at).otherwise(F.lit(0))
