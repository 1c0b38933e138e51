"""What the training-data operators share: the shared folder, written
intermediate tables, bucketed global ranks and Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coordex.written import clear_scratch, materialize, scratch_path, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_last_key(col: Column) -> Column:
    """A string that is never null and sorts as the column by code point, null last."""
    return F.when(col.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), col.cast("string")))


def seeded(seed: str, *cols: Column) -> Column:
    """md5 of seed and columns: a shuffle order any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols]))


def unit(digest: Column) -> Column:
    """The first 52 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, salts: int = 64) -> DataFrame:
    """Left join on keys that are never null, where one key may hold a third of the
    left rows: they are dealt over ``salts`` parts by ``spread``, and the right
    row (one a key) meets each part that is there."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(F.lit(41), spread), F.lit(salts)))
    parts = left.select(*keys, "_salt").distinct().join(right, keys)
    return left.join(parts, [*keys, "_salt"], "left").drop("_salt")


def prefix_rank(
    df: DataFrame,
    keys: list[str],
    position: Column,
    order: list[str],
    rank: str,
    weight: str | None = None,
    running: str | None = None,
) -> DataFrame:
    """Rank (from 1) and running weight of each row among the rows of its keys.

    ``position`` is a whole-number bucket that grows with ``order``; buckets are
    counted first (partial aggregation), the counts are summed up per key, and
    rows are ordered inside a bucket only. No key needs to fit into one task.
    """
    at = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", position)
    summed = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*at).agg(*summed)
    sums = sums.select(
        *at,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0")] if weight else []),
    )
    inside = Window.partitionBy(*at).orderBy(*order)
    out = rows.join(sums, at).withColumn(rank, F.col("_n0") + F.row_number().over(inside))
    if weight:
        upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(running, F.col("_w0") + F.sum(weight).over(upto))
    return out.drop("_bucket", "_n0", "_w0")


def buckets_for(n: int, per_bucket: int = 2000) -> int:
    return max(1, -(-n // per_bucket))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def rebatched(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``limit`` bytes in ``column`` (a longer value comes alone)."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, n in enumerate(_lengths(sizes)):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _lengths(array: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_pylist()
