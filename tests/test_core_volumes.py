"""Resizing and resampling by parts that don't grow with the table."""

import random

from coordex.operators import volumes as W

SCHEMA = "image_id string, i int, j int, k int, v double"


def some(spark, images, seed):
    rng = random.Random(seed)
    cells = [(f"x{m}", i, j, k, float(rng.randrange(99))) for m in range(images) for i in range(6) for j in range(5) for k in range(4) if rng.random() < 0.6]
    return spark.createDataFrame(cells, SCHEMA).repartition(4)


def test_resized_voxels_are_dealt_before_they_multiply(spark):
    df = W.resize_area(some(spark, 3, 1), (6, 5, 4), (4, 9, 3))
    assert df.rdd.getNumPartitions() == W.PARTS


def test_images_are_resampled_together(spark, monkeypatch):
    voxels, matrix = some(spark, 30, 2), ((0.5, 0, 0, 0.25), (0, 0.5, 0.25, 0), (0, 0, 0.5, -0.5))
    take = lambda: sorted(map(tuple, W.resample(voxels, matrix, (12, 9, 8), block=4).collect()))
    want = take()
    assert "FlatMapGroups" not in W.resample(voxels, matrix, (12, 9, 8), block=4)._jdf.queryExecution().toString()
    monkeypatch.setattr(W, "CELLS", 100)  # an image at a time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # blocks over many batches
    try:
        assert take() == want != []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
