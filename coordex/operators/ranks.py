"""Order statistics of groups of any size: ranks, running maxima, exact quantiles.

Rows are dealt by range and counted (or their maxima taken) per range; what lies in
the ranges before is summed over the ranges, of which there are few; rows are ordered
inside a range alone. A group that holds all rows is spread like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coordex.written import materialize

#: Values of one interval that are ordered as they are; more are told apart by a histogram first.
KEEP, BINS = 4096, 1024


def same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased tables; always true without keys."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def _ranges(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """The rows, written by range, with the number of their range (growing with by and order)."""
    return materialize(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), name)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """rank (from 1) of each row among the rows of its group, in the order of the columns."""
    rows = _ranges(df, by, order, "ranked")
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_own")).withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    placed = rows.withColumn("_nth", F.row_number().over(inside))
    out = placed.alias("r").join(counts.alias("c"), same("r", "c", [*by, "_range"]))
    return out.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("c._before") + F.col("r._nth")).alias(name))


def running_max(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The largest value of the rows before each row of its group, or null. Rows of one
    place in the order stand in any order among themselves."""
    rows = _ranges(df, by, [order], "running")
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*by, "_range").agg(F.max(value).alias("_own")).withColumn("_before", F.max("_own").over(before))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_seen", F.max(value).over(inside))
    out = seen.alias("r").join(tops.alias("t"), same("r", "t", [*by, "_range"]))
    return out.select(*[F.col(f"r.{c}") for c in df.columns], F.greatest("r._seen", "t._before").alias(name))


def _bin(x: Column, low: Column, high: Column, scaled: bool) -> Column:
    """Which of BINS bins of [low, high] x lies in: it never falls as x grows, and the ends
    lie apart. Scaled bins are even in magnitude, so that few large values don't hide the rest."""
    squeeze = (lambda v: F.signum(v) * (F.log2(F.abs(v) + F.lit(2.0**-1000)) + 1000)) if scaled else (lambda v: v)
    a, b, c = squeeze(x) / 2, squeeze(low) / 2, squeeze(high) / 2
    inner = F.least(F.floor(F.nanvl((a - b) / F.nullif(c - b, F.lit(0.0)), F.lit(0.5)) * BINS), F.lit(BINS - 1)).cast("int")
    return F.when(x <= low, 0).when(x >= high, BINS - 1).otherwise(F.coalesce(inner, F.lit(0)))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = (), keep: int = KEEP) -> DataFrame:
    """by and a column for each name in ``shares``: the exact quantile, interpolated
    between neighbours. Nulls and NaN do not count; a group without values has no row.

    Each asked rank has an interval, at first from the least to the largest value. While
    more than ``keep`` values lie in it, they are counted in bins, and the bin that holds
    the rank (from its own least to its own largest value) is the next interval. No
    values are buffered or sorted but the last few.
    """
    by = list(by)
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("_x"))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    asked = [F.struct(F.lit(f"{name}|{end}").alias("_what"), f(place(p)).cast("long").alias("_rank")) for name, p in shares.items() for end, f in (("low", F.floor), ("high", F.ceil))]
    state = [*by, "_what", "_rank", "_n", "_below", "_low", "_high", "_in"]
    targets = groups.select("*", F.explode(F.array(*asked)).alias("_a")).select(*by, "_a._what", "_a._rank", "_n", F.lit(0).cast("long").alias("_below"), "_low", "_high", F.col("_n").alias("_in"))
    targets = materialize(targets.where("_n > 0"), "quantiles")
    meets = lambda t: rows.alias("r").join(t.alias("t"), same("r", "t", by) & F.col("r._x").between(F.col("t._low"), F.col("t._high")))
    wide = (F.col("_in") > keep) & (F.col("_low") < F.col("_high"))
    scaled = True
    while not targets.where(wide).isEmpty():
        at = _bin(F.col("r._x"), F.col("t._low"), F.col("t._high"), scaled)
        bins = meets(targets.where(wide)).groupBy(*[F.col(f"t.{c}").alias(c) for c in state if c not in ("_low", "_high", "_in")], at.alias("_bin"))
        bins = bins.agg(F.count(F.lit(1)).alias("_in"), F.min("r._x").alias("_low"), F.max("r._x").alias("_high"))
        upto = Window.partitionBy(*by, "_what").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
        bins = bins.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_in").over(upto), F.lit(0)))
        hit = bins.where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_in")))
        targets = materialize(hit.select(*state).unionByName(targets.where(~wide)), "quantiles")
        scaled = False
    flat = targets.where("_low = _high").select(*by, "_what", "_rank", "_n", F.col("_low").alias("_value"))
    few = meets(targets.where("_low < _high")).select(*[F.col(f"t.{c}").alias(c) for c in state], F.col("r._x").alias("_value"))
    nth = F.row_number().over(Window.partitionBy(*by, "_what").orderBy("_value")) - 1  # ``keep`` rows
    few = few.withColumn("_nth", nth).where(F.col("_nth") == F.col("_rank") - F.col("_below")).select(*flat.columns)
    found = flat.unionByName(few)
    at = lambda name, end: F.max(F.when(F.col("_what") == f"{name}|{end}", F.col("_value")))
    n = F.max("_n")

    def between(name: str, p: float) -> Column:
        part = F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1))
        low, high = at(name, "low"), at(name, "high")
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name)

    return found.groupBy(*by).agg(n.alias("_n"), *[between(name, p) for name, p in shares.items()]).where("_n > 0").drop("_n")
