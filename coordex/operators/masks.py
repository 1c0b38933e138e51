"""Masks and volumes as sparse voxel tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coordex.config import SPHERE_ALPHA, SPHERE_RADIUS, VOLUME_SHAPE
from coordex.functions.geometry import blend, inside, norm
from coordex.written import materialize

VOXEL = ["i", "j", "k"]


def binarise(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("v", F.when(F.col("v") > 0, 1.0).otherwise(0.0))


def overlap(pred: DataFrame, truth: DataFrame, ignore_empty: bool = True) -> DataFrame:
    """tp, fp, fn, dice and iou per image (foreground only); images without truth
    have no score, or are left out of a mean by being null."""
    side = lambda df, name: df.select("image_id", *VOXEL).distinct().withColumn(name, F.lit(1))
    both = side(pred, "p").join(side(truth, "t"), ["image_id", *VOXEL], "full")
    out = both.groupBy("image_id").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    scored = (F.col("tp") + F.col("fn") > 0) if ignore_empty else F.lit(True)
    total = F.col("tp") + F.col("fp") + F.col("fn")
    return out.withColumn("dice", F.when(scored, 2 * F.col("tp") / (F.col("tp") + total))).withColumn("iou", F.when(scored, F.col("tp") / total))


def surface(voxels: DataFrame) -> DataFrame:
    """Voxels of which a face neighbour is missing: the extremes of directed
    distances lie here when the sets differ in extent."""
    own = voxels.select("image_id", *VOXEL).distinct()
    near = F.array(*[F.struct(*[(F.col(c) + (s if c == d else 0)).alias(c) for c in VOXEL]) for d in VOXEL for s in (-1, 1)])
    around = own.select("image_id", F.explode(near).alias("x")).select("image_id", "x.*").groupBy("image_id", *VOXEL).count()
    return own.join(around, ["image_id", *VOXEL], "left").where("coalesce(count, 0) < 6").select("image_id", *VOXEL)


def lower_envelope(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each line (row of f) and place p: the least f[q] + (x[p] - x[q])^2 over the
    line's places q. x grows; absent places are infinite. The parabolas that make up
    the least are kept in a stack, so the work is linear in the places; all lines at once."""
    lines, n = f.shape
    stack, edge, top = np.zeros((lines, n), np.int64), np.full((lines, n), -np.inf), np.full(lines, -1)
    for q in range(n):
        todo = np.flatnonzero(np.isfinite(f[:, q]))
        while len(todo):
            t = top[todo]
            v = stack[todo, np.maximum(t, 0)]
            cut = (f[todo, q] + x[q] ** 2 - f[todo, v] - x[v] ** 2) / (2 * np.where(t >= 0, x[q] - x[v], 1.0))
            cut = np.where(t >= 0, cut, -np.inf)
            over = (t >= 0) & (cut <= edge[todo, np.maximum(t, 0)])
            put, at = todo[~over], t[~over] + 1
            stack[put, at], edge[put, at], top[put] = q, cut[~over], at
            todo = todo[over]
            top[todo] -= 1
    out, at = np.full((lines, n), np.inf), np.zeros(lines, np.int64)
    some = np.flatnonzero(top >= 0)
    for p in range(n):
        todo = some
        while len(todo):
            nxt = np.minimum(at[todo] + 1, n - 1)
            todo = todo[(at[todo] < top[todo]) & (edge[todo, nxt] <= x[p])]
            at[todo] += 1
        q = stack[some, at[some]]
        out[some, p] = f[some, q] + (x[p] - x[q]) ** 2
    return out


def _slices(voxels: pa.Table, columns: pa.Table) -> list[np.ndarray]:
    """Squared distances inside slices: for each side, slice k with its voxels and column
    (i, j) of the other side's, that of the column to the slice's nearest voxel."""
    out = []
    side, cside = voxels.column("side").to_numpy(), columns.column("side").to_numpy()
    i, j, k = (voxels.column(c).to_numpy() for c in VOXEL)
    ci, cj = (columns.column(c).to_numpy() for c in "ij")
    for s in (0, 1):
        own, other = side == s, cside != s
        if not own.any() or not other.any():
            continue
        (x, xi), (y, yi), (z, zi) = (np.unique(c, return_inverse=True) for c in (np.concatenate([i[own], ci[other]]), np.concatenate([j[own], cj[other]]), k[own]))
        n = int(own.sum())
        box = np.full((len(z), len(y), len(x)), np.inf)
        box[zi, yi[:n], xi[:n]] = 0
        box = lower_envelope(box.reshape(-1, len(x)), x.astype(float)).reshape(box.shape).transpose(0, 2, 1)
        box = lower_envelope(np.ascontiguousarray(box).reshape(-1, len(y)), y.astype(float)).reshape(box.shape)
        found = box[:, xi[n:], yi[n:]]
        out.append(np.stack([np.full(found.size, s), np.tile(ci[other], len(z)), np.tile(cj[other], len(z)), np.repeat(z, other.sum()), found.ravel().astype(np.int64)]))
    return out


def _farthest(voxels: pa.Table, planes: pa.Table) -> int | None:
    """The largest squared distance of a voxel to the other side, along the columns' last axis."""
    worst = None
    side, pside = voxels.column("side").to_numpy(), planes.column("side").to_numpy()
    pi, pj, pk, q = (planes.column(c).to_numpy() for c in ("i", "j", "k", "q"))
    i, j, k = (voxels.column(c).to_numpy() for c in VOXEL)
    for s in (0, 1):
        own, other = side == s, pside != s
        if not own.any() or not other.any():
            continue
        n = int(other.sum())
        column, at = np.unique(np.stack([np.concatenate([pi[other], i[own]]), np.concatenate([pj[other], j[own]])]), axis=1, return_inverse=True)
        at = at.ravel()
        z, zi = np.unique(np.concatenate([pk[other], k[own]]), return_inverse=True)
        box = np.full((column.shape[1], len(z)), np.inf)
        box[at[:n], zi[:n]] = q[other]
        worst = max(worst or 0, int(lower_envelope(box, z.astype(float))[at[n:], zi[n:]].max()))
    return worst


def hausdorff(pred: DataFrame, truth: DataFrame, slab: int = 16) -> DataFrame:
    """Per image with both masks, by an exact distance transform that is taken apart by
    axes: first inside the slices of one mask, at the columns that the other occupies, then
    along the columns. A task holds ``slab`` slices or planes. Rows without an image_id go."""
    name = pred.schema["image_id"].dataType.simpleString()
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]
    whole = [F.col(c).cast("long").alias(c) for c in VOXEL]
    sides = [df.where("image_id is not null").select("image_id", F.lit(s).alias("side"), *whole).distinct() for s, df in enumerate((pred, truth))]
    both = materialize(sides[0].unionByName(sides[1]), "hausdorff")
    slabs = lambda df, axis: df.withColumn("slab", F.floor(F.col(axis) / slab))
    meets = slabs(both, "k").select("image_id", "slab", (1 - F.col("side")).alias("side")).distinct()
    columns = both.select("image_id", "side", "i", "j").distinct().join(meets, ["image_id", "side"])
    columns = columns.select(*[F.col(c).alias(c) for c in columns.columns])  # attributes of its own, for the cogroup

    def inside(key: tuple, voxels: pa.Table, at: pa.Table) -> pa.Table:
        found = _slices(voxels, at)
        cols = np.concatenate(found, 1) if found else np.zeros((5, 0), np.int64)
        return pa.table([pa.array([key[0].as_py()] * cols.shape[1], kind), pa.array(cols[0].astype(np.int32)), *[pa.array(c) for c in cols[1:]]], ["image_id", "side", "i", "j", "k", "q"])

    cut = ["image_id", "slab"]
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    planes = slabs(both, "k").groupBy(*cut).cogroup(columns.groupBy(*cut)).applyInArrow(inside, f"image_id {name}, side int, i long, j long, k long, q long")

    def along(key: tuple, voxels: pa.Table, at: pa.Table) -> pa.Table:
        worst = _farthest(voxels, at)
        return pa.table([pa.array([] if worst is None else [key[0].as_py()], kind), pa.array([] if worst is None else [worst], pa.int64())], ["image_id", "q"])

    worst = slabs(both, "i").groupBy(*cut).cogroup(fresh(slabs(planes, "i")).groupBy(*cut)).applyInArrow(along, f"image_id {name}, q long")
    return worst.groupBy("image_id").agg(F.sqrt(F.max("q").cast("double")).alias("hausdorff"))


def mask_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return overlap(pred, truth).join(hausdorff(pred, truth), "image_id", "left")


def minmax(df: DataFrame, value: str = "v", by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Scaled to 0..1 within each group; null where all values are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", (F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def matching_shape(image_meta: DataFrame, shape: tuple[int, ...] = VOLUME_SHAPE) -> tuple[DataFrame, DataFrame]:
    """Images of the shape, and the rejected ones."""
    same = F.col("shape").eqNullSafe(F.array(*[F.lit(n) for n in shape]))
    return image_meta.where(same), image_meta.where(~same)


def sphere(centres: DataFrame, radius: float = SPHERE_RADIUS) -> DataFrame:
    """Rows with i, j, k, and a shape -> the voxels of a ball around each, inside the volume."""
    r = int(radius)
    span = F.sequence(F.lit(-r), F.lit(r))
    out = centres
    for c in VOXEL:
        out = out.withColumn(f"d{c}", F.explode(span))
    out = out.where(norm(F.col("di"), F.col("dj"), F.col("dk")) <= radius)
    out = out.withColumns({c: F.col(c) + F.col(f"d{c}") for c in VOXEL}).drop("di", "dj", "dk")
    return out.where(inside(F.array(*VOXEL), F.col("shape")))


def in_volume(points: DataFrame) -> DataFrame:
    """Marks centres outside their volume instead of failing."""
    return points.withColumn("in_volume", inside(F.array(*VOXEL), F.col("shape")))


def overlay(voxels: DataFrame, ball: DataFrame, colour: tuple[float, float, float] = (1.0, 0.0, 0.0), alpha: float = SPHERE_ALPHA) -> DataFrame:
    """r, g, b of each voxel: grey, blended with the colour inside the ball."""
    marked = voxels.join(ball.select("image_id", *VOXEL).distinct().withColumn("_in", F.lit(True)), ["image_id", *VOXEL], "left")
    channel = lambda c: F.when(F.col("_in"), blend(F.col("v"), F.lit(c), alpha)).otherwise(F.col("v"))
    return marked.select("image_id", *VOXEL, *[channel(c).alias(n) for n, c in zip("rgb", colour)])


def busiest_slice(voxels: DataFrame, axis: str = "k") -> DataFrame:
    """Per image the slice with the largest sum; ties go to the first."""
    sums = voxels.groupBy("image_id", axis).agg(F.sum("v").alias("total"))
    best = F.max_by(F.struct(axis, "total"), F.struct("total", -F.col(axis)))
    return sums.groupBy("image_id").agg(best.alias("b")).select("image_id", f"b.{axis}", "b.total")


def orthogonal_slices(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """The three planes through each image's point, a quarter turned to the left as
    they are shown: image_id, plane, row, col and the voxels' other columns.

    points: image_id, i, j, k and the shape of the volume, a row an image.
    """
    rest = [c for c in voxels.columns if c not in ("image_id", *VOXEL)]
    at = points.select("image_id", *[F.col(c).alias(f"_{c}") for c in VOXEL], F.col("shape").alias("_shape"))
    # plane, fixed axis, axes of rows and columns before the turn
    sides = (("axial", 2, 0, 1), ("sagittal", 1, 0, 2), ("coronal", 0, 1, 2))

    def side(plane: str, fixed: int, row: int, col: int):
        turned = F.get("_shape", F.lit(col)) - 1 - F.col(VOXEL[col])
        cell = F.struct(F.lit(plane).alias("plane"), turned.cast("long").alias("row"), F.col(VOXEL[row]).cast("long").alias("col"))
        return F.when(F.col(VOXEL[fixed]) == F.col(f"_{VOXEL[fixed]}"), cell)

    cells = F.explode(F.array_compact(F.array(*[side(*s) for s in sides]))).alias("_cell")
    return voxels.join(at, "image_id").select("image_id", cells, *rest).select("image_id", "_cell.*", *rest)
