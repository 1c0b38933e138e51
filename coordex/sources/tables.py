"""CSV and Parquet in and out, reports and archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordex.config import MEASUREMENTS, WIDE
from coordex.functions.text import counter_label, format_vector, parse_vector


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def read_measurements(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The nine columns by name (and extra text columns); absent ones are null."""
    raw = spark.read.option("header", True).csv(path)
    have = {c for c in raw.columns}
    columns = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in MEASUREMENTS]
    return nan_to_null(raw.select(*columns, *[c for c in extra if c in have]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_positions(positions: DataFrame, path: str) -> None:
    """Vectors as text, "[x y z]"."""
    write_csv(positions.withColumns({w: format_vector(F.col(w)) for w in WIDE}), path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).withColumns({w: parse_vector(F.col(w)) for w in WIDE})


def counter_lines(report: DataFrame) -> DataFrame:
    """counter, value -> lines of the log."""
    return report.select(F.concat(counter_label(F.col("counter")), F.lit(": "), F.col("value").cast("string")).alias("value"))


def write_pairs_archive(pairs: DataFrame, folder: str) -> DataFrame:
    """mask, volume (binary) with subject, session, run -> a tar.gz for each task."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        path, n = f"{base}/part-{TaskContext.get().partitionId():05d}.tar.gz", 0
        with files.open_output_stream(path + ".attempt") as out, tarfile.open(fileobj=out, mode="w|gz") as tar:
            for b in batches:
                for r in b.to_pylist():
                    for kind in ("mask", "volume"):
                        info = tarfile.TarInfo(f"sub-{r['subject']}_ses-{r['session']}_run-{r['run']}/{kind}.nii.gz")
                        info.size = len(r[kind])
                        tar.addfile(info, io.BytesIO(r[kind]))
                    n += 1
        files.move(path + ".attempt", path)
        yield pa.record_batch([pa.array([path]), pa.array([n])], ["path", "pairs"])

    return pairs.select("subject", "session", "run", "mask", "volume").mapInArrow(write, "path string, pairs long")
