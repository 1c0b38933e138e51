"""Volumes in new grids, their likeness, and voxel tables in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordex.operators.masks import VOXEL

#: Voxels of blocks that a task resamples at once, and parts of the rows that are resized.
CELLS, PARTS = 1 << 19, 256
Matrix = tuple[tuple[float, float, float, float], ...]


def resize_area(voxels: DataFrame, shape: tuple[int, int, int], new_shape: tuple[int, int, int]) -> DataFrame:
    """image_id, i, j, k, v in a grid of new_shape: each new voxel is the mean of the old
    ones from floor(o n / m) to before ceil((o + 1) n / m) on each axis. Absent voxels count
    as 0, and what no voxel touches is absent. Voxels are dealt over ``PARTS`` by image and
    new i before the other axes multiply them, so a task sums few new voxels."""
    out, size = voxels.select("image_id", *VOXEL, F.col("v").cast("double").alias("v")), F.lit(1)
    for c, n, m in zip(VOXEL, shape, new_shape):
        first, last = F.floor(F.col(c) * m / n), F.ceil((F.col(c) + 1) * m / n) - 1
        out = out.where(F.col(c).between(0, n - 1)).withColumn(f"_{c}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        if c == VOXEL[0]:
            out = out.repartition(PARTS, "image_id", f"_{c}")
    for c, n, m in zip(VOXEL, shape, new_shape):
        size = size * (F.ceil((F.col(f"_{c}") + 1) * n / m) - F.floor(F.col(f"_{c}") * n / m))
    return out.groupBy("image_id", *[f"_{c}" for c in VOXEL]).agg(F.sum(F.col("v") / size).alias("v")).withColumnsRenamed({f"_{c}": c for c in VOXEL})


def resample(voxels: DataFrame, matrix: Matrix, new_shape: tuple[int, int, int], block: int = 32) -> DataFrame:
    """image_id, i, j, k, v in a grid of new_shape, whose voxel p has the trilinear value at
    matrix p (three rows of an affine transform to old voxels). Old voxels that are absent or
    outside count as 0; new ones without any old neighbour are absent.

    An old voxel goes to the blocks of the new grid that may look at it (its place mapped
    back, give or take a voxel). Blocks of one place are alike in every image, so a task
    takes that block of many images at once; it holds ``CELLS`` voxels, or one block and its
    halo, if that is more, and a batch of rows.
    """
    name = voxels.schema["image_id"].dataType.simpleString()
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]
    part, shift = np.array(matrix, float)[:, :3], np.array(matrix, float)[:, 3]
    back = np.linalg.inv(part)
    rows = voxels.select("image_id", *VOXEL, F.col("v").cast("double").alias("v"))
    for axis, c in enumerate(VOXEL):
        at = sum((F.lit(float(back[axis, a])) * (F.col(x) - F.lit(float(shift[a]))) for a, x in enumerate(VOXEL)), F.lit(0.0))
        reach = float(np.abs(back[axis]).sum()) + 1e-6
        low, high = F.greatest(F.ceil(at - reach), F.lit(0)), F.least(F.floor(at + reach), F.lit(new_shape[axis] - 1))
        blocks = F.when(low <= high, F.sequence(F.floor(low / block), F.floor(high / block)))
        rows = rows.withColumn(f"_{c}", F.explode(blocks))

    def geometry(at: tuple[int, ...]):
        """A block's new voxels, and for each corner its places in the box of old ones and its weights."""
        axes = [np.arange(f * block, min((f + 1) * block, n)) for f, n in zip(at, new_shape)]
        new = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
        place = new @ part.T + shift
        low = np.floor(place).astype(np.int64)
        share = place - low
        base = low.min(0)
        size = low.max(0) - base + 2
        corners = [(np.ravel_multi_index((low + c - base).T, size), np.where(c, share, 1 - share).prod(1)) for c in product((0, 1), repeat=3)]
        return new, base, size, corners

    def images_of(at: tuple[int, ...], old: pa.Table) -> Iterator[pa.RecordBatch]:
        """All images of one block, as many at a time as fit into ``CELLS``."""
        new, base, size, corners = geometry(at)
        names = old.column("image_id").combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        image = names.indices.to_numpy(zero_copy_only=False)
        cell = np.stack([old.column(c).to_numpy() for c in VOXEL], 1).astype(np.int64) - base
        value = old.column("v").to_numpy()
        near = ((cell >= 0) & (cell < size)).all(1)
        image, flat, value = image[near], np.ravel_multi_index(cell[near].T, size), value[near]
        many = max(1, CELLS // max(int(size.prod()), len(new)))
        for start in range(0, len(names.dictionary), many):
            on = (image >= start) & (image < start + many)
            lines = min(many, len(names.dictionary) - start)
            box = np.full((lines, int(size.prod())), np.nan)
            box[image[on] - start, flat[on]] = value[on]
            total, met = np.zeros((lines, len(new))), np.zeros((lines, len(new)), bool)
            for place, weight in corners:
                able = np.flatnonzero(weight > 0)
                found = box[:, place[able]]
                some = ~np.isnan(found)
                total[:, able] += np.where(some, weight[able] * found, 0)
                met[:, able] |= some
            r, c = np.nonzero(met)
            named = names.dictionary.take(pa.array(r + start))
            yield pa.record_batch([named.cast(kind), *[pa.array(new[c, x].astype(np.int32)) for x in range(3)], pa.array(total[r, c])], ["image_id", *VOXEL, "v"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block and image; the last image of a batch waits for its rest."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            cuts = _changes([held.column(c) for c in (*at, "image_id")])
            if len(cuts) > 1:
                yield from blocks_of(held.slice(0, cuts[-1]))
                held = held.slice(cuts[-1]).combine_chunks()
        if held is not None:
            yield from blocks_of(held)

    def blocks_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = [*_changes([table.column(c) for c in at]), table.num_rows]
        for first, last in zip(cuts, cuts[1:]):
            yield from images_of(tuple(int(table.column(c)[first].as_py()) for c in at), table.slice(first, last - first))

    at = [f"_{c}" for c in VOXEL]
    rows = rows.repartition("image_id", *at).sortWithinPartitions(*at, "image_id")
    return rows.mapInArrow(gather, f"image_id {name}, i int, j int, k int, v double")


def _changes(columns: list[pa.ChunkedArray]) -> list[int]:
    """Where a row differs from the one before it; the first row does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = c.combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def _bins(voxels: DataFrame, bins: int, name: str) -> DataFrame:
    """Voxels with the bin of their value between the image's least and largest."""
    ends = voxels.groupBy("image_id").agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    share = (F.col("v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    level = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return voxels.join(ends, "image_id").select("image_id", *VOXEL, level.alias(name))


def joint_histogram(fixed: DataFrame, moving: DataFrame, matrix: Matrix, bins: int = 256) -> DataFrame:
    """image_id, a, b, weight: how often a value of the fixed volume meets one of the moving
    volume at matrix p, where each of the eight voxels around counts by its share (partial
    volume). Voxels that are absent from either table don't count."""
    at = [sum((F.lit(float(r[a])) * F.col(c) for a, c in enumerate(VOXEL)), F.lit(float(r[3]))) for r in matrix]
    rows = _bins(fixed, bins, "a").select("image_id", "a", *[x.alias(f"_{c}") for c, x in zip(VOXEL, at)])
    corner = lambda c, up: (F.floor(f"_{c}") + up).cast("int").alias(c)
    share = lambda c, up: (F.col(f"_{c}") - F.floor(f"_{c}")) if up else (1 - F.col(f"_{c}") + F.floor(f"_{c}"))
    corners = [F.struct(*[corner(c, up) for c, up in zip(VOXEL, ups)], (share("i", ups[0]) * share("j", ups[1]) * share("k", ups[2])).alias("w")) for ups in product((0, 1), repeat=3)]
    near = rows.select("image_id", "a", F.explode(F.array(*corners)).alias("x")).select("image_id", "a", "x.*").where("w > 0")
    met = near.join(_bins(moving, bins, "b"), ["image_id", *VOXEL])
    return met.groupBy("image_id", "a", "b").agg(F.sum("w").alias("weight"))


def mutual_information(fixed: DataFrame, moving: DataFrame, matrix: Matrix = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0)), bins: int = 256) -> DataFrame:
    """image_id, weight, nmi: the entropies of both volumes over that of both together; null
    where they meet in one pair of values only. The histogram has bins x bins rows an image."""
    joint = joint_histogram(fixed, moving, matrix, bins)
    tables = [joint.groupBy("image_id", *c).agg(F.sum("weight").alias("w")).select("image_id", F.lit(n).alias("of"), "w") for n, c in (("a", ["a"]), ("b", ["b"]), ("ab", ["a", "b"]))]
    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    # Entropy from sums: log2(W) - sum(w log2 w) / W.
    sums = every.groupBy("image_id", "of").agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.log2("w")).alias("wl"))
    entropy = lambda n: F.max(F.when(F.col("of") == n, F.log2("all") - F.col("wl") / F.col("all")))
    out = sums.groupBy("image_id").agg(F.max("all").alias("weight"), entropy("a").alias("ha"), entropy("b").alias("hb"), entropy("ab").alias("hab"))
    return out.select("image_id", "weight", F.when(F.col("hab") > 1e-12, (F.col("ha") + F.col("hb")) / F.col("hab")).alias("nmi"))


# ---- blocks


def morton(i: Column, j: Column, k: Column) -> Column:
    """The bits of three whole numbers (0 to 2^21 - 1) in turns, those of i highest."""

    def spread(c: Column) -> Column:
        c = c.cast("long")
        for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
        return c

    return F.shiftleft(spread(i), 2).bitwiseOR(F.shiftleft(spread(j), 1)).bitwiseOR(spread(k))


def morton_code(i: int, j: int, k: int) -> int:
    return sum(((x >> bit & 1) << (3 * bit + 2 - axis)) for axis, x in enumerate((i, j, k)) for bit in range(21))


def write_blocks(voxels: DataFrame, path: str, zone: int = 64, block: int = 8) -> None:
    """A voxel table (coordinates from 0) in zones of ``zone`` voxels a side, a folder each,
    named by the zone's Morton code; inside, rows lie by image and block."""
    code = lambda side: morton(*[F.floor(F.col(c) / side) for c in VOXEL])
    rows = voxels.withColumn("zone", code(zone)).withColumn("_block", code(block))
    rows = rows.repartitionByRange("zone", "image_id", "_block").sortWithinPartitions("zone", "image_id", "_block").drop("_block")
    rows.write.partitionBy("zone").parquet(path)


def read_box(spark: SparkSession, path: str, low: tuple[int, int, int], high: tuple[int, int, int], zone: int = 64) -> DataFrame:
    """Voxels with low <= (i, j, k) <= high of a table of ``write_blocks``; folders of other zones are not read."""
    spans = [range(max(0, floor(a / zone)), floor(b / zone) + 1) for a, b in zip(low, high)]
    zones = sorted(morton_code(*z) for z in product(*spans))  # as many as the box has zones
    inside = F.lit(True)
    for c, a, b in zip(VOXEL, low, high):
        inside = inside & F.col(c).between(a, b)
    return spark.read.parquet(path).where(F.col("zone").isin(zones) & inside).drop("zone")


def read_ball(spark: SparkSession, path: str, centre: tuple[float, float, float], radius: float, zone: int = 64) -> DataFrame:
    """Voxels of a table of ``write_blocks`` at most radius from the centre."""
    low, high = (tuple(f(c + s * radius) for c in centre) for f, s in ((ceil, -1), (floor, 1)))
    far = sum(((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(VOXEL, centre)), F.lit(0.0))
    return read_box(spark, path, low, high, zone).where(far <= radius * radius)


def read_slice(spark: SparkSession, path: str, axis: str, at: int, shape: tuple[int, int, int], zone: int = 64) -> DataFrame:
    low, high = [0, 0, 0], [n - 1 for n in shape]
    low[VOXEL.index(axis)] = high[VOXEL.index(axis)] = at
    return read_box(spark, path, tuple(low), tuple(high), zone)
