"""Volumes as a Spark data source: ``spark.read.format("nifti")`` and ``write.format("nifti")``.

    spark.dataSource.register(NiftiSource)
    spark.read.format("nifti").option("content", "headers").load(folder)
    write_volumes(voxels, image_meta, folder)

Reading: a partition a file below the folder (any file system that pyarrow knows and all
executors share; option ``glob``, by default ``*.nii*``). ``content`` is ``headers`` (shape
and affine from the first bytes, nothing else is read) or ``voxels`` (those above 0, all
with ``foreground`` false). With ``pushdown`` true (and spark.sql.python.filterPushdown.enabled
on), conditions on image_id choose the files and those on i, j and k the slices that become rows.
A file that can't be read is a header row with an error and gives no voxels.

Writing: rows of one image follow each other in one task (``write_volumes`` sees to it).
Files come into being in a folder of the job's own, are moved to their names when the job
commits, and go with that folder when it does not; an attempt that fails takes its files along.
"""

from __future__ import annotations

import fnmatch
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from coordex.sources.nifti import decode, encode, header

HEADERS = "image_id string, shape array<int>, affine array<array<double>>, error string"
VOXELS = "image_id string, i int, j int, k int, v double"
VOLUMES = "image_id string, i int, j int, k int, v double, shape array<int>, affine array<array<double>>"
ROWS = 1 << 18


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def head(stream) -> bytes:
    """The first 352 bytes of a file, unpacked; no more is read than they take."""
    raw = stream.read(4096)
    if raw[:2] != b"\x1f\x8b":
        return raw[:352]
    unpack, out = zlib.decompressobj(31), b""
    while raw and len(out) < 352:
        out += unpack.decompress(raw, 352 - len(out))
        raw = unpack.unconsumed_tail or stream.read(4096)
    return out


@dataclass
class File(InputPartition):
    path: str


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.nii*")
        self.headers, self.foreground = options.get("content", "voxels") == "headers", options.get("foreground", "true") == "true"
        self.names: set[str] | None = None
        self.span = {c: [None, None] for c in "ijk"}

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = _files(self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob) and "/_attempts/" not in f.path)
        return [File(p) for p in paths if self.names is None or p in self.names]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        if self.headers:
            try:
                with system.open_input_stream(partition.path, compression=None) as f:
                    shape, affine, *_ = header(head(f))
                row = (partition.path, list(shape), affine.tolist(), None)
            except Exception as e:  # a damaged file is a row, not the end of the scan
                row = (partition.path, None, None, str(e))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64())), pa.string())
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], ["image_id", "shape", "affine", "error"])
            return
        try:
            with system.open_input_stream(partition.path, compression=None) as f:
                volume, _ = decode(f.read())
        except Exception:
            return  # listed with its error among the headers
        volume = volume.reshape(volume.shape[:3]) if volume.ndim > 3 and volume.size == np.prod(volume.shape[:3]) else volume
        first = [max(0, self.span[c][0] or 0) for c in "ijk"]
        part = volume[tuple(slice(a, None if self.span[c][1] is None else max(a, self.span[c][1] + 1)) for a, c in zip(first, "ijk"))]
        at = np.nonzero(part > 0) if self.foreground else np.nonzero(np.ones(part.shape, bool))
        for s in range(0, len(at[0]), ROWS):
            cut = tuple(x[s : s + ROWS] for x in at)
            cols = [pa.array([partition.path] * len(cut[0])), *[pa.array((x + a).astype(np.int32)) for x, a in zip(cut, first)], pa.array(part[cut].astype(float))]
            yield pa.record_batch(cols, ["image_id", "i", "j", "k", "v"])


class PrunedReader(NiftiReader):
    """Takes conditions over; Spark asks that the session's setting for it is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        if not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or len(f.attribute) != 1:
            return False
        (column,), value = f.attribute, getattr(f, "value", None)
        if column == "image_id" and isinstance(f, (EqualTo, In)):
            names = set(value) if isinstance(f, In) else {value}
            self.names = names if self.names is None else self.names & names
            return True
        if self.headers or column not in self.span or isinstance(f, In) or not isinstance(value, int):
            return False
        low, high = self.span[column]
        if not isinstance(f, (LessThan, LessThanOrEqual)):
            least = value + isinstance(f, GreaterThan)
            low = least if low is None else max(low, least)
        if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            most = value - isinstance(f, LessThan)
            high = most if high is None else min(high, most)
        self.span[column] = [low, high]
        return True


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class NiftiWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.dtype, self.suffix = options["path"], options.get("dtype", "f4"), options.get("suffix", ".nii.gz")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _own(self, base: str) -> str:
        return f"{base}/_attempts/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        system, base = _files(self.path)
        folder, names = f"{self._own(base)}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        held, rows = None, []

        def out() -> None:
            volume = np.zeros(held["shape"], self.dtype)
            if rows:
                at = np.array([r[:3] for r in rows], np.int64)
                volume[tuple(at.T)] = [r[3] for r in rows]
            name = held["image_id"].rpartition("/")[2] + self.suffix
            if name in names:
                raise ValueError(f"two images are named {name}, or rows of one are apart")
            with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(encode(volume, np.array(held["affine"])))
            names.append(name)

        try:
            for row in iterator:
                if held is not None and row["image_id"] != held["image_id"]:
                    out()
                    rows = []
                held = row
                if row["i"] is not None:
                    rows.append((row["i"], row["j"], row["k"], row["v"]))
            if held is not None:
                out()
        except BaseException:
            system.delete_dir(folder)
            raise
        return Written(names, folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = _files(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(base)):
                if f.type == fs.FileType.File and f.base_name.endswith(self.suffix):
                    system.delete_file(f.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{m.folder}/{name}", f"{base}/{name}")
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_files(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(self._own(base)).type == fs.FileType.Directory:
            system.delete_dir(self._own(base))
        top = f"{base}/_attempts"
        if system.get_file_info(top).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)


class NiftiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return HEADERS if self.options.get("content", "voxels") == "headers" else VOXELS

    def reader(self, schema) -> NiftiReader:
        return (PrunedReader if self.options.get("pushdown") == "true" else NiftiReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NiftiWriter:
        return NiftiWriter(dict(self.options), overwrite)


def write_volumes(voxels: DataFrame, image_meta: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """A file for each image of image_meta (image_id, shape, affine), also for those without
    voxels. An image's voxels are one task's, as its file is."""
    voxels.sparkSession.dataSource.register(NiftiSource)
    rows = image_meta.select("image_id", "shape", "affine").join(voxels.select("image_id", "i", "j", "k", "v"), "image_id", "left")
    rows = rows.select("image_id", *[F.col(c).cast("int").alias(c) for c in "ijk"], F.col("v").cast("double").alias("v"), "shape", "affine")
    rows = rows.repartition("image_id").sortWithinPartitions("image_id")
    rows.write.format("nifti").mode(mode).options(**options).save(path)
