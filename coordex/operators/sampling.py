"""Seeded splits and running bests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coordex.operators.ranks import running_max


def split_dataset(items: DataFrame, key: str, n_validation: int, n_test: int, seed: int = 1001) -> DataFrame:
    """Exact sizes: the first by a seeded hash are validation, the next test, the rest train.

    Only validation and test members are ordered (a distributed top-k); the rest
    is told apart by a join, so no task sorts the whole table."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))  # an order that any engine can repeat
    head = items.select(key).distinct().orderBy(h, key).limit(n_validation + n_test)
    place = F.row_number().over(Window.orderBy(h, key))  # n_validation + n_test rows
    head = head.withColumn("_place", place)
    out = items.join(head, key, "left")
    subset = F.when(F.col("_place") <= n_validation, "validation").when(F.col("_place").isNotNull(), "test").otherwise("train")
    return out.withColumn("subset", subset).drop("_place")


def create_dataset(volumes: DataFrame, masks: DataFrame, n_validation: int, n_test: int, seed: int = 1001) -> DataFrame:
    """Volumes with their masks, split: the inventory's pairs and a subset each.
    An inventory without pairs is an error."""
    from coordex.sources.inventory import pairs

    found = pairs(volumes, masks)
    if not found.limit(1).count():
        raise ValueError("no volume has a mask")
    key = F.concat_ws("|", "subject", "session", "run").alias("case")
    return split_dataset(found.select("*", key), "case", n_validation, n_test, seed)


def running_best(metrics: DataFrame, by: tuple[str, ...] = ("run_id", "tag")) -> DataFrame:
    """best: the largest value so far, at least 0; improved: strictly above all before (and 0).
    A tag's steps are cut into ranges, so a tag with all rows is spread."""
    seen = running_max(metrics, list(by), "step", "value", "_before")
    before = F.greatest(F.coalesce("_before", F.lit(0.0)), F.lit(0.0))
    return seen.withColumn("best", F.greatest(before, F.col("value"))).withColumn("improved", F.col("value") > before).drop("_before")


def best_step(metrics: DataFrame, by: tuple[str, ...] = ("run_id", "tag")) -> DataFrame:
    """The earliest step with the best value; none if nothing is above 0."""
    return metrics.where("value > 0").groupBy(*by).agg(F.max_by("step", F.struct("value", -F.col("step"))).alias("step"), F.max("value").alias("best"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run_id", "tag").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def append_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select("run_id", "tag", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)
