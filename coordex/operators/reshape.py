"""Wide positions to long measurements, and their union with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordex.config import AUTO_RATER, DIMENSIONS, FULL, LONG, PLACEHOLDER, WIDE
from coordex.functions.text import capitalize


def add_missing(df: DataFrame, **constants: str) -> DataFrame:
    """Constant columns, only where the column is not there."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items() if k not in df.columns})


def to_long(positions: DataFrame, experiment: str = PLACEHOLDER, rater: str = AUTO_RATER, method: str = FULL) -> DataFrame:
    """A row per electrode and dimension, nine columns in order; none for an electrode without a vector."""
    rows = positions.unpivot([c for c in positions.columns if c not in WIDE], list(WIDE), "name", "vector")
    rows = rows.select("*", F.posexplode("vector").alias("at", "Coordinates"))
    rows = add_missing(rows, Experiment=experiment, Rater=rater, Method=method)
    names = F.array(*[F.lit(d) for d in DIMENSIONS])
    return rows.withColumns({
        "Electrode": capitalize(F.regexp_replace("name", "_mni$", "")),
        "Dimension": F.get(names, "at"),
    }).withColumnsRenamed({"subject": "Subject", "session": "Session"}).select(*LONG)


def to_wide(measurements: DataFrame) -> DataFrame:
    """The inverse of ``to_long`` for one rater and method: a vector an electrode."""
    keys = ["Subject", "Session", "run"]
    first = lambda e, d: F.min(F.when((F.col("Electrode") == e) & (F.col("Dimension") == d), F.col("Coordinates")))
    vector = {w: F.array(*[first(capital, d) for d in DIMENSIONS]) for w, capital in zip(WIDE, ("Anode", "Cathode1", "Cathode2", "Cathode3"))}
    return measurements.groupBy(*keys).agg(*[v.alias(k) for k, v in vector.items()]).withColumnsRenamed({"Subject": "subject", "Session": "session"})


def merge_measurements(long: DataFrame, baseline: DataFrame, ordered: bool = True) -> DataFrame:
    """Union by name (duplicates stay, missing columns are null); extra baseline
    columns come last by name; sorted by the nine columns, nulls last."""
    out = long.select(*LONG).unionByName(baseline, allowMissingColumns=True)
    out = out.select(*LONG, *sorted(c for c in out.columns if c not in LONG))
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in LONG]) if ordered else out
