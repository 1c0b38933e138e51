"""Incremental ingestion: only files and measurements that are new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coordex.config import MEASUREMENTS
from coordex.sources.inventory import with_keys

BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, glob: str = "*.nii*") -> DataFrame:
    """A stream of inventory rows, each file once (the checkpoint remembers)."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return with_keys(files.select("path"))


def new_measurements(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MEASUREMENTS).parquet(folder)


def running_counts(measurements: DataFrame) -> DataFrame:
    """Rows and mean per method and electrode so far (update or complete mode)."""
    return measurements.groupBy("Method", "Electrode").agg(F.count(F.lit(1)).alias("n"), F.avg("Coordinates").alias("mean"))


def process_new(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each micro-batch once to ``handle``; ends when all there is was handled."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
