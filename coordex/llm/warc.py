"""WARC: dictionary-compressed writer and reader.

A Zstandard dictionary is trained on a bounded sample of records (``SAMPLE``
pages at most, chosen by hash over all of them) and embedded in a leading
skippable frame of every archive; each record is a Zstandard frame of its own,
so that records can be read singly. Of records with equal payloads (SHA-1 and
length) the one with the largest page_id is a ``response``, the others are
``revisit`` records that refer to it and hold no payload.

Archives are real files below the shared folder, written by the tasks under an
attempt name and then renamed, so a task that runs again leaves one file of the
same content. They end after ``ROTATE`` bytes, and are read back with Spark's
binaryFile source.

Defined results: null html is an empty payload; a null page_id counts as smaller
than any; of rows with one page_id and payload the one with the largest url is the
response, of fully repeated rows any one; url may be null (the record has no
target); a very long page is one record, held whole by the task that writes or
reads it; an empty table gives no archive and no rows; extra columns are ignored.

Scale: digests are grouped with partial aggregation on narrow rows; a payload
shared by a third of all rows is one row a task there, and what its pages learn of
their response comes by a salted join. Fully repeated rows are one row a task
before pages move, which they do once, dealt by page, url and digest. The dictionary is at most ``DICT_SIZE`` bytes and travels with the
task's code.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, salted_join, scratch_path, table

# The magic numbers of the formats.
SKIPPABLE, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
SAMPLE, SAMPLE_BYTES, DICT_SIZE, LEVEL = 1000, 16 << 20, 64 << 10, 3
ROTATE = 16 << 20
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_uri(page_id: int | None, nth: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{nth}"


def warc_record(page_id, nth: int, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: headers, block, two line ends."""
    head = HEAD % len(payload)
    block = head + (b"" if refers_to else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_uri(page_id, nth)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields | {"payload": payload, "payload_length": length}


def train_dictionary(samples: list[bytes], size: int = DICT_SIZE) -> bytes:
    """Trained where the samples allow it; else their raw end serves as content."""
    total = sum(map(len, samples))
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(max(256, min(size, total // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def _dict_data(raw: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


class ArchiveWriter:
    """Appends records, each a frame of its own; ``close`` moves the file into place."""

    def __init__(self, uri: str, dictionary: bytes):
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(uri)
        self.path, self.part = path, f"{path}.attempt-{uuid.uuid4().hex}"
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.part)
        self.z = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict_data(dictionary) if dictionary else None)
        self.size = self.out.write(frame := leading_frame(dictionary)) or len(frame)

    def add(self, record: bytes) -> tuple[int, int]:
        frame = self.z.compress(record)
        self.out.write(frame)
        self.size += len(frame)
        return self.size - len(frame), len(frame)

    def close(self) -> None:
        from pyarrow.fs import FileType

        self.out.close()
        # Another attempt of the task may have left the same archive already.
        if self.files.get_file_info(self.path).type == FileType.File:
            self.files.delete_file(self.path)
        self.files.move(self.part, self.path)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of one archive, frame by frame."""
    view, at, z = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic == struct.pack("<I", SKIPPABLE):
            size = struct.unpack("<I", view[at + 4 : at + 8])[0]
            raw = bytes(view[at + 8 : at + 8 + size])
            z = zstandard.ZstdDecompressor(dict_data=_dict_data(raw)) if raw else z
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        frame, out = z.decompressobj(), []
        while not frame.eof:
            step = view[at : at + (1 << 16)]
            if not len(step):
                raise ValueError("frame is cut short")
            out.append(frame.decompress(step))
            at += len(step) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(out)


def _named(pages: DataFrame) -> DataFrame:
    """Adds ``name``: page_id and url as one string that is never null and tells all of them apart."""
    return pages.withColumn("name", F.to_json(F.struct("page_id", "url")))


def roles(pages: DataFrame) -> DataFrame:
    """name, digest, bytes, times (rows that are the same), leads, to_id (the
    response's page_id): narrow rows only."""
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = materialize(_named(pages).select("page_id", "url", "name", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes")), "warc-digests")
    # Partial aggregation: a hot payload is one row a task.
    same = rows.groupBy("digest", "bytes", "name").agg(F.count(F.lit(1)).alias("times"))
    best = rows.groupBy("digest", "bytes").agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id", F.coalesce("url", F.lit("")), "name")).alias("best"))
    best = best.select("digest", "bytes", F.col("best.page_id").alias("to_id"), F.col("best.name").alias("lead"))
    return salted_join(same, best, ["digest", "bytes"], F.col("name")).withColumn("leads", F.col("name") == F.col("lead")).drop("lead")


def write_archives(pages: DataFrame, path: str, dictionary: bytes) -> DataFrame:
    """Writes all pages below ``path``; returns a row per archive and record:
    archive, position, length, page_id. Only archives of this index are whole: an attempt
    that died may leave files in the folder which are in none."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = _named(pages).select("page_id", "url", "name", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    # The limit holds in each task before rows move.
    first = F.row_number().over(Window.partitionBy("name", "digest", "bytes").orderBy("page_id"))
    full = full.withColumn("nth", first).where("nth = 1").join(roles(pages), ["name", "digest", "bytes"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, archive = TaskContext.get().partitionId(), 0, None
        for b in batches:
            rows = {"archive": [], "position": [], "length": [], "page_id": []}
            for page_id, url, payload, digest, to_id, leads, times in zip(*[c.to_pylist() for c in b.columns]):
                for nth in range(times):
                    if archive is None:
                        # A name of this attempt's own: what a lost attempt leaves is in no index.
                        archive = ArchiveWriter(uri := f"{path}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.warc.zst", dictionary)
                    refers = None if leads and nth == 0 else record_uri(to_id, 0)
                    at, n = archive.add(warc_record(page_id, nth, url, payload, base32(digest), refers))
                    for k, v in zip(rows, (uri, at, n, page_id)):
                        rows[k].append(v)
                    if archive.size >= ROTATE:
                        archive.close()
                        archive, number = None, number + 1
            yield pa.record_batch([pa.array(rows["archive"], pa.string()), *[pa.array(rows[k], pa.int64()) for k in ("position", "length", "page_id")]], list(rows))
        if archive is not None:
            archive.close()

    full = full.sortWithinPartitions("name", "digest", "bytes").select("page_id", "url", "payload", "digest", "to_id", "leads", "times")
    return materialize(full.mapInArrow(write, "archive string, position long, length long, page_id long"), "warc-index")


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Of all archives of a folder, or of the named ones, a row per record: record_id, page_id, record_type, url, payload_digest,
    refers_to_id, payload (null in revisits), payload_bytes of what is held."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "record_type", "url", "payload_digest", "refers_to_id", "payload", "payload_bytes"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for data in read_archive(content.as_py()):
                    r = parse_record(data)
                    uri, kind = r["WARC-Record-ID"].strip("<>"), r["WARC-Type"]
                    name = uri.split(":")[2]
                    digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32(hashlib.sha1(r["payload"]).hexdigest()) != digest:
                        raise ValueError(f"{uri}: payload does not match its digest")
                    rows.append((uri, int(name) if name else None, kind, r.get("WARC-Target-URI"), digest, r.get("WARC-Refers-To", "").strip("<>") or None, r["payload"] if kind == "response" else None, len(r["payload"]) if kind == "response" else None))
                    held += len(r["payload"])
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(read, "record_id string, page_id long, record_type string, url string, payload_digest string, refers_to_id string, payload binary, payload_bytes long")


def dictionary_of(pages: DataFrame, limit: int = SAMPLE) -> bytes:
    """From ``limit`` different pages at most, the least by hash over all of them, and of
    those as many as fit into SAMPLE_BYTES, each whole."""
    h = F.xxhash64(F.lit(7), "page_id", "url", F.xxhash64("html"))
    sized = pages.select("page_id", F.octet_length("html").alias("n"), h.alias("h")).where("n > 0")
    # Equal rows are one: a hash that many rows share is chosen once.
    ids = sized.groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(limit).collect()
    chosen, held = [], 0
    for r in ids:
        if held + r.n <= SAMPLE_BYTES:
            chosen.append(r.h)
            held += r.n
    if not chosen:
        return b""
    least = pages.select("page_id", "url", "html", h.alias("h")).where(F.col("h").isin(chosen)).dropDuplicates(["h"])
    return train_dictionary([warc_record(r.page_id, 0, r.url, r.html.encode(), "A" * 32, None) for r in least.orderBy("h").collect() if r.html])


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write, then read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url per page, all from the archives."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    index = write_archives(pages, path, dictionary_of(pages))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    if not index.limit(1).count():
        return spark.createDataFrame([], schema)
    # As many names as a scan of the folder would list: a file of ROTATE bytes each.
    names = [r.archive for r in index.select("archive").distinct().collect()]
    records = read_archives(spark, names).drop("payload")
    records = materialize(records, "warc-read")
    keys = {"refers_to_id": F.coalesce("refers_to_id", F.lit("")), "payload_digest": F.col("payload_digest")}
    # Ids of responses are unique with their digests: no page_id is a response twice for one payload.
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), "payload_digest", F.col("payload_bytes").alias("full"), F.col("page_id").alias("to"))
    # A revisit says whom it refers to; its payload and length are that record's.
    out = salted_join(records.withColumns(keys), held, list(keys), F.col("record_id"))
    return out.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to"), "url")


def op2_warc(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages")).drop("url")


ORACLE = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS lead,
    array_to_string(list_transform(string_split_regex(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS b FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(('0b' || substr(b, CAST(i * 5 + 1 AS INTEGER), 5)) AS INTEGER) + 1]), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM bits
"""
