"""Written intermediate tables: they cut lineage, survive lost executors, and later
readers see the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a session on one machine may
    go without it (tests) and gets a temporary folder; elsewhere that is an error, as
    executors don't see each other's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="coordex-"))
    return "file://" + _OWN[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/coordex/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once to the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Lists the tables that ``materialize`` writes inside it, in order, and deletes at its
    end those that are still in the list."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        for name in _OPEN.pop():
            _delete(spark, name)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written below the shared folder; results
    that have not been written elsewhere can't be read afterwards."""
    _delete(spark, f"{shared_dir(spark)}/coordex/{spark.sparkContext.applicationId}")
