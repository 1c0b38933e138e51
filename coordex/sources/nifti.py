"""NIfTI-1 volumes: decoder, encoder, reader and writer."""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordex.functions.text import name_parts

# Data types of the format.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {np.dtype(v).str[1:]: k for k, v in DTYPES.items()}


def _quaternion(b: float, c: float, d: float, offset, pixdim) -> np.ndarray:
    a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
    r = np.array([
        [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
        [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
        [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
    ])
    affine = np.eye(4)
    affine[:3, :3] = r * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)])
    affine[:3, 3] = offset
    return affine


def header(data: bytes) -> tuple[tuple[int, ...], np.ndarray, np.dtype, int, float, float]:
    """shape, affine, data type, where the data start, slope and intercept, from the first 352 bytes."""
    if len(data) < 352:
        raise ValueError("too short for a NIfTI-1 file")
    order = next((o for o in "<>" if struct.unpack_from(o + "i", data)[0] == 348), None)
    if order is None or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    get = lambda kind, at: struct.unpack_from(order + kind, data, at)
    dim = get("8h", 40)
    shape = tuple(max(1, n) for n in dim[1 : 1 + dim[0]])
    (code,) = get("h", 70)
    if code not in DTYPES:
        raise ValueError(f"data type {code}")
    pixdim, (start, slope, inter) = get("8f", 76), get("3f", 108)
    qform, sform = get("2h", 252)
    if sform > 0:
        affine = np.vstack([np.array(get("12f", 280), float).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        affine = _quaternion(*get("3f", 256), get("3f", 268), pixdim)
    else:
        affine = np.diag([pixdim[1] or 1.0, pixdim[2] or 1.0, pixdim[3] or 1.0, 1.0])
    return shape, affine, np.dtype(DTYPES[code]).newbyteorder(order), int(start), slope, inter


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The volume as stored (scaled where a slope is given) and its 4 x 4 affine."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    shape, affine, dtype, start, slope, inter = header(data)
    volume = np.frombuffer(data, dtype, int(np.prod(shape)), start).reshape(shape, order="F")
    if slope not in (0.0, 1.0) or (slope and inter):
        volume = volume * (slope or 1.0) + inter
    return volume, affine


def encode(volume: np.ndarray, affine: np.ndarray, compress: bool = True) -> bytes:
    """A single-file NIfTI-1 image with an sform."""
    volume = np.asarray(volume)
    if volume.ndim != 3:
        raise ValueError("a volume has three axes")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *volume.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, CODES[volume.dtype.str[1:]], volume.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *np.sqrt((np.asarray(affine)[:3, :3] ** 2).sum(0)), 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, *np.asarray(affine, float)[:3].ravel())
    head[344:348] = b"n+1\0"
    data = bytes(head) + volume.astype(volume.dtype.newbyteorder("<")).tobytes(order="F")
    return gzip.compress(data, mtime=0) if compress else data


def canonical(volume: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes reordered and flipped to the closest right-anterior-superior frame."""
    part, order, free = np.abs(affine[:3, :3]), [-1, -1, -1], {0, 1, 2}
    for _ in range(3):
        world, axis = max(((w, a) for w in range(3) if order[w] < 0 for a in free), key=lambda x: (part[x], -x[0], -x[1]))
        order[world] = axis
        free.discard(axis)
    volume = np.transpose(volume, order)
    affine = affine[:, [*order, 3]].copy()
    for axis in range(3):
        if affine[axis, axis] < 0:
            volume = np.flip(volume, axis)
            affine[:3, 3] += affine[:3, axis] * (volume.shape[axis] - 1)
            affine[:3, axis] *= -1
    return volume, affine


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.withColumn("keys", name_parts(F.col("path")))


def read_images(spark: SparkSession, root: str, glob: str = "*.nii*") -> DataFrame:
    """image_meta of all volumes, with an error column for those that can't be read."""

    def meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column("content"):
                try:
                    v, a = decode(content.as_py())
                    rows.append((list(v.shape), a.tolist(), None))
                except Exception as e:  # a damaged file is a row, not the end of the scan
                    rows.append((None, None, str(e)))
            new = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64())), pa.string()))]
            yield pa.record_batch([b.column(i) for i in range(5)] + new, ["image_id", "subject", "session", "run", "path", "shape", "affine", "error"])

    files = _listed(spark, root, glob).select(F.col("path").alias("image_id"), "keys.subject", "keys.session", "keys.run", "path", "content")
    return files.mapInArrow(meta, "image_id string, subject string, session string, run string, path string, shape array<int>, affine array<array<double>>, error string")


def read_voxels(spark: SparkSession, root: str, glob: str = "*.nii*", foreground: bool = True) -> DataFrame:
    """image_id, i, j, k, v of the voxels above 0 (or all); unreadable files give none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    v, _ = decode(content.as_py())
                except Exception:
                    continue  # listed with its error by read_images
                at = np.nonzero(v > 0) if foreground else np.nonzero(np.ones(v.shape, bool))
                for s in range(0, len(at[0]), 1 << 18):
                    part = [x[s : s + (1 << 18)] for x in at[:3]]
                    yield pa.record_batch([pa.array([name] * len(part[0])), *[pa.array(x.astype(np.int32)) for x in part], pa.array(v[tuple(part)].astype(float))], ["image_id", "i", "j", "k", "v"])

    files = _listed(spark, root, glob).select(F.col("path").alias("image_id"), "content")
    return files.mapInArrow(rows, "image_id string, i int, j int, k int, v double")


def write_masks(voxels: DataFrame, image_meta: DataFrame, folder: str, suffix: str = "_mask.nii.gz", dtype: str = "u1") -> DataFrame:
    """One file per image below ``folder`` (any pyarrow file system that all
    executors share); affine kept. Returns image_id and path."""

    def write(v: pa.Table, m: pa.Table) -> pa.Table:
        from pyarrow import fs

        if not m.num_rows:
            return pa.table({"image_id": pa.array([], pa.string()), "path": pa.array([], pa.string())})
        r = m.to_pylist()[0]
        volume = np.zeros(r["shape"], dtype)
        if v.num_rows:
            volume[tuple(v.column(c).to_numpy() for c in "ijk")] = 1
        files, base = fs.FileSystem.from_uri(folder)
        name = "_".join(f"{k}-{r[f]}" for k, f in (("sub", "subject"), ("ses", "session"), ("run", "run")) if r[f]) or r["image_id"].rpartition("/")[2]
        files.create_dir(base, recursive=True)
        path = f"{base}/{name}{suffix}"
        attempt = f"{path}.{uuid.uuid4().hex}.attempt"  # two attempts of a task write files of their own
        with files.open_output_stream(attempt) as out:
            out.write(encode(volume, np.array(r["affine"])))
        files.move(attempt, path)
        return pa.table({"image_id": [r["image_id"]], "path": [path]})

    return voxels.groupBy("image_id").cogroup(image_meta.groupBy("image_id")).applyInArrow(write, "image_id string, path string")
