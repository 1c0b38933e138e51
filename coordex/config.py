"""Schemas and domain values of repeated 3-D coordinate measurements."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
ELECTRODES = ("Anode", "Cathode1", "Cathode2", "Cathode3")  # the order matters
DIMENSIONS = ("X", "Y", "Z")
FULL, HALF, SEMI, MANUAL, BASELINE = "full-automated", "half-automated", "semi-automated", "manually", "baseline"
AREAS = {"P1": "rOTC", "P3": "lTPJ", "P7": "rDLPFC"}
PLACEHOLDER = "YourExperimentName"
AUTO_RATER = "Network"
N_CLUSTERS, SIZE_SHARE = 4, 0.2
NEAR, FAR = 5.0, 70.0
SD_LIMIT, IQR_LIMIT = 1.96, 1.5
SPHERE_RADIUS, SPHERE_ALPHA = 2.0, 0.5
VOLUME_SHAPE = (224, 288, 288)
GROUP = ["Subject", "Session", "run"]
LONG = ["Experiment", *GROUP, "Rater", "Method", "Electrode", "Dimension", "Coordinates"]
COORDINATES_OF_INTEREST = ("Euclidean_Norm", "X", "Y", "Z")
WIDE = ("anode_mni", "cathode1_mni", "cathode2_mni", "cathode3_mni")

MEASUREMENTS = T.StructType([T.StructField(c, T.DoubleType() if c == "Coordinates" else T.StringType()) for c in LONG])
IMAGE_META = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("image_id", "subject", "session", "run", "path")],
    T.StructField("shape", T.ArrayType(T.IntegerType())),
    T.StructField("affine", T.ArrayType(T.ArrayType(T.DoubleType()))),
])
VOXELS = T.StructType([T.StructField("image_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in "ijk"], T.StructField("v", T.DoubleType())])
POSITIONS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("subject", "session", "run")], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in WIDE]])
METRICS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("step", T.LongType()), T.StructField("value", T.DoubleType())])
