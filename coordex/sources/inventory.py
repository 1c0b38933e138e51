"""File inventories and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordex.functions.text import file_name, name_parts, parent

# What files are by their names.
KINDS = {"T1": r"mprage_T1w\.nii(\.gz)?$|_T1w\.nii(\.gz)?$", "Petra_Pre": r"petra_run-01_PDw\.nii(\.gz)?$", "Petra_Post": r"petra_run-02_PDw\.nii(\.gz)?$", "Inference": r"inference.*\.nii(\.gz)?$|_segmented\.nii(\.gz)?$", "Mask": r"mask\.nii(\.gz)?$"}


def with_keys(paths: DataFrame) -> DataFrame:
    """path -> path, name, subject, session, run, kind (null where nothing matches)."""
    kind = F.lit(None).cast("string")
    for k, pattern in KINDS.items():
        kind = F.when(F.col("path").rlike(pattern), k).otherwise(kind)
    return paths.withColumn("_k", name_parts(F.col("path"))).select("path", file_name(F.col("path")).alias("name"), "_k.*", kind.alias("kind"))


def inventory(spark: SparkSession, root: str, glob: str = "*.nii*") -> DataFrame:
    """All files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return with_keys(files.select("path"))


def folders(files: DataFrame) -> DataFrame:
    """Distinct parents of the listed files: name and parent name."""
    return files.select(parent(F.col("path")).alias("folder"), parent(F.col("path"), 2).alias("above")).distinct()


def subjects(files: DataFrame, lengths: tuple[int, ...] = (7, 8)) -> DataFrame:
    """Files whose subject folder's name has one of the lengths."""
    name = F.concat(F.lit("sub-"), F.col("subject"))
    return files.where(F.length(name).isin(*lengths))


def nested(files: DataFrame) -> DataFrame:
    """subject -> sessions with their kinds and paths."""
    per = files.groupBy("subject", "session").agg(F.sort_array(F.collect_list(F.struct("kind", "path"))).alias("files"))
    return per.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("session", "files"))).alias("sessions"))


def pairs(volumes: DataFrame, masks: DataFrame) -> DataFrame:
    """Volumes with their masks, by subject, session and run."""
    keys = ["subject", "session", "run"]
    return volumes.select(*keys, F.col("path").alias("volume")).join(masks.select(*keys, F.col("path").alias("mask")), keys)


def unmatched(volumes: DataFrame, masks: DataFrame) -> DataFrame:
    """What has no partner, on either side."""
    keys = ["subject", "session", "run"]
    return volumes.join(masks, keys, "left_anti").withColumn("missing", F.lit("mask")).unionByName(masks.join(volumes, keys, "left_anti").withColumn("missing", F.lit("volume")))


def to_process(inputs: DataFrame, outputs: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Inputs that have no output yet; all of them with ``overwrite``."""
    return inputs if overwrite else inputs.join(outputs, keys, "left_anti")


def processed(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that have an output."""
    return inputs.join(outputs, keys, "left_semi")


def coregistration_jobs(files: DataFrame, done: DataFrame, base: str = "base") -> DataFrame:
    """Sessions with a Petra_Pre and a base T1 of their subject, without output yet:
    Petra_Pre is the source, the T1 the reference, and a Petra_Post, if there is one
    (else null), is moved along. A session with a Petra_Post alone is no job, nor is the
    base session itself; two files of one kind give a job each."""
    t1 = files.where((F.col("kind") == "T1") & (F.col("session") == base)).select("subject", F.col("path").alias("reference"))
    scan = lambda k: files.where((F.col("kind") == k) & (F.col("session") != base)).select("subject", "session", F.col("path").alias(k))
    jobs = scan("Petra_Pre").join(t1, "subject").join(scan("Petra_Post"), ["subject", "session"], "left")
    return jobs.join(done.select("subject", "session").distinct(), ["subject", "session"], "left_anti")


def deletable(files: DataFrame) -> DataFrame:
    """A dry run: the inference files that a clean-up would delete. Nothing is deleted."""
    return files.where((F.col("kind") == "Inference") & F.col("path").contains("/unzipped/")).select("path")
