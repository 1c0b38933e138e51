"""Views that bind the operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordex.config import AUTO_RATER, ELECTRODES, FULL, HALF, LONG, MANUAL

RATERS = {FULL: AUTO_RATER, HALF: "human_a", MANUAL: "human_b"}
HUMAN = ("human_a", "human_b")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four consecutive vectors are one image; a point for each method: h, f, m."""
    v = read(spark, sf_dir, "embeddings")
    image = F.expr("vec_id div 4")
    at = lambda k: F.col("embedding")[k].cast("double")
    h = [100.0 * at(k) for k in range(3)]
    point = lambda base: F.array(*[h[k] + 25.0 * at(base + k) for k in range(3)]) if base else F.array(*h)
    names = F.array(*[F.lit(e) for e in ELECTRODES])
    idx = (F.col("vec_id") % 4).cast("int")
    swapped = F.when(F.col("image") % 3 == 1, F.when(idx % 2 == 0, idx + 1).otherwise(idx - 1)).otherwise(idx)
    rows = v.withColumn("image", image)
    subject = F.expr("image div 8")
    return rows.select(
        "image", idx.alias("idx"),
        F.format_string("sub-%03d", subject).alias("Subject"),
        F.concat(F.lit("ses-"), (F.expr("image div 2") % 4 + 1).cast("string")).alias("Session"),
        F.concat(F.lit("run-0"), (F.col("image") % 2 + 1).cast("string")).alias("run"),
        F.element_at(F.array(F.lit("P1"), F.lit("P3"), F.lit("P7")), (subject % 3 + 1).cast("int")).alias("Experiment"),
        F.get(names, idx).alias("Electrode"), F.get(names, swapped).alias("FullElectrode"),
        point(0).alias("h"), point(3).alias("f"), point(6).alias("m"),
        F.array(*[250.0 * at(k) for k in range(3)]).alias("c"),
    )


def measurements(spark: SparkSession, sf_dir: str, methods: tuple[str, ...] = (FULL, HALF, MANUAL)) -> DataFrame:
    """Long measurements of the three methods."""
    e = electrodes(spark, sf_dir)
    held = {FULL: ("FullElectrode", "f"), HALF: ("Electrode", "h"), MANUAL: ("Electrode", "m")}
    each = F.explode(F.array(*[F.struct(F.lit(RATERS[x]).alias("Rater"), F.lit(x).alias("Method"), F.col(held[x][0]).alias("Electrode"), F.col(held[x][1]).alias("v")) for x in methods]))
    rows = e.select("Experiment", "Subject", "Session", "run", each.alias("x")).select("Experiment", "Subject", "Session", "run", "x.*")
    rows = rows.select("*", F.posexplode("v").alias("at", "Coordinates"))
    return rows.withColumn("Dimension", F.get(F.array(F.lit("X"), F.lit("Y"), F.lit("Z")), "at")).select(*LONG)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide positions of the half-automated points."""
    e = electrodes(spark, sf_dir)
    vector = lambda k: F.min(F.when(F.col("idx") == k, F.col("h")))
    out = e.groupBy("Subject", "Session", "run").agg(*[vector(k).alias(w) for k, w in enumerate(("anode_mni", "cathode1_mni", "cathode2_mni", "cathode3_mni"))])
    return out.withColumnsRenamed({"Subject": "subject", "Session": "session"})


def voxels(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """All lines as voxels: an image for each supplier and return flag; with ``flag`` those
    of one flag, an image a supplier (the pairs of masks). Images have sides of 4 to 12, so
    some are dense (one cluster) and some sparse (many)."""
    v = read(spark, sf_dir, "lineitem")
    image = F.col("l_suppkey")
    if flag is None:
        image = image * 4 + F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    else:
        v = v.where(F.col("l_returnflag") == flag)
    side = 4 + 2 * (F.col("l_suppkey") % 5)
    return v.select(image.alias("image_id"), (F.col("l_partkey") % side).cast("int").alias("i"), (F.col("l_orderkey") % side).cast("int").alias("j"), F.col("l_linenumber").alias("k")).distinct()


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of all suppliers, and one that has no voxel."""
    s = read(spark, sf_dir, "supplier").select(F.explode(F.array(*[F.col("s_suppkey") * 4 + k for k in range(3)])).alias("image_id"))
    return s.unionByName(spark.createDataFrame([(-1,)], "image_id long"))


# ---- the same views in SQL

E = """
e0 AS (
  SELECT vec_id // 4 AS image, CAST(vec_id % 4 AS INTEGER) AS idx, list_transform(embedding[1:9], lambda x: x::DOUBLE) AS v FROM embeddings
), e1 AS (
  SELECT image, idx, printf('sub-%03d', image // 8) AS Subject, 'ses-' || ((image // 2) % 4 + 1) AS Session, 'run-0' || (image % 2 + 1) AS run,
    ['P1', 'P3', 'P7'][(image // 8) % 3 + 1] AS Experiment, ['Anode', 'Cathode1', 'Cathode2', 'Cathode3'][idx + 1] AS Electrode,
    ['Anode', 'Cathode1', 'Cathode2', 'Cathode3'][CASE WHEN image % 3 <> 1 THEN idx WHEN idx % 2 = 0 THEN idx + 1 ELSE idx - 1 END + 1] AS FullElectrode,
    [100.0::DOUBLE * v[1], 100.0::DOUBLE * v[2], 100.0::DOUBLE * v[3]] AS h,
    [100.0::DOUBLE * v[1] + 25.0::DOUBLE * v[4], 100.0::DOUBLE * v[2] + 25.0::DOUBLE * v[5], 100.0::DOUBLE * v[3] + 25.0::DOUBLE * v[6]] AS f,
    [100.0::DOUBLE * v[1] + 25.0::DOUBLE * v[7], 100.0::DOUBLE * v[2] + 25.0::DOUBLE * v[8], 100.0::DOUBLE * v[3] + 25.0::DOUBLE * v[9]] AS m,
    [250.0::DOUBLE * v[1], 250.0::DOUBLE * v[2], 250.0::DOUBLE * v[3]] AS c
  FROM e0
)"""
M = E + """, m0 AS (
  SELECT Experiment, Subject, Session, run, 'Network' AS Rater, 'full-automated' AS Method, FullElectrode AS Electrode, f AS p FROM e1
  UNION ALL SELECT Experiment, Subject, Session, run, 'human_a', 'half-automated', Electrode, h FROM e1
  UNION ALL SELECT Experiment, Subject, Session, run, 'human_b', 'manually', Electrode, m FROM e1
), ml AS (
  SELECT Experiment, Subject, Session, run, Rater, Method, Electrode, ['X', 'Y', 'Z'][d] AS Dimension, p[d] AS Coordinates FROM m0, (SELECT unnest([1, 2, 3]) AS d)
)"""
#: Vectors after the recode half -> semi, as the agreement queries use them.
V = M + """, vec AS (
  SELECT Experiment, Subject, Session, run, Rater, CASE Method WHEN 'half-automated' THEN 'semi-automated' ELSE Method END AS Method, Electrode,
    avg(CASE WHEN Dimension = 'X' THEN Coordinates END) AS X, avg(CASE WHEN Dimension = 'Y' THEN Coordinates END) AS Y, avg(CASE WHEN Dimension = 'Z' THEN Coordinates END) AS Z
  FROM ml GROUP BY ALL
), vn AS (
  SELECT *, sqrt(X * X + Y * Y + Z * Z) AS Euclidean_Norm, CASE Experiment WHEN 'P1' THEN 'rOTC' WHEN 'P3' THEN 'lTPJ' WHEN 'P7' THEN 'rDLPFC' END AS Area FROM vec
)"""


def pair_sql(coi: str, m1: str, m2: str, name: str = "pr", source: str = "vn") -> str:
    return f"""{name} AS (
  SELECT *, m1 - m2 AS Difference, (m1 + m2) / 2 AS Mean FROM (
    SELECT Subject, Session, run, Area, Electrode, min(CASE WHEN Method = '{m1}' THEN {coi} END) AS m1, min(CASE WHEN Method = '{m2}' THEN {coi} END) AS m2
    FROM {source} GROUP BY ALL) WHERE m1 IS NOT NULL AND m2 IS NOT NULL
)"""


_CELL = "CAST(l_partkey % (4 + 2 * (l_suppkey % 5)) AS INTEGER) AS i, CAST(l_orderkey % (4 + 2 * (l_suppkey % 5)) AS INTEGER) AS j, l_linenumber AS k FROM lineitem"
VOX = "SELECT DISTINCT l_suppkey AS image_id, " + _CELL + " WHERE l_returnflag = '{flag}'"
#: All lines, an image for each supplier and flag.
EVERY_VOX = "SELECT DISTINCT l_suppkey * 4 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS image_id, " + _CELL
