"""Document fingerprints: canonical exact digest.

A text is normalised (NFKC, case folding, NFKC again, white space folded to one
blank and trimmed) and digested with 128-bit xxh3. Equal digests form buckets;
inside a bucket the canonical bytes themselves are compared, so that two texts
share a fingerprint only if their canonical forms are the same. Edited texts are
named by the same rule; a second digest of 64 bits tells whether one of them clashes
with a document, and if any text clashes, all are named again with their bytes.

Defined results: a null text counts as empty; empty and blank-only texts share
one class; repeated rows give repeated rows; rows are in order of a hash of their
text, then the text, where doc_id repeats or is null (nulls first); a very long text
is handled whole by the task that holds it; an empty table gives an empty table;
further columns of the input are ignored.

Scale: texts move twice, as Zstandard frames: once dealt by ranges of doc_id and
hash (neighbours), so that many rows without doc_id are many ranges, once by digest
with map-side combination, so a text repeated in a third of all rows is one row a
task before it moves.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

LEVEL = 3


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


Digest = Callable[[bytes], str]


def likeness(a: str, b: str) -> float:
    """An exact digest knows equal or not."""
    return float(a == b)


def check(canon: bytes) -> int:
    """A second digest, as a signed number."""
    n = xxhash.xxh3_64_intdigest(canon, seed=1)
    return n - (n >> 63 << 64)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.record_batch([b.column(0), pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], ["doc_id", "z"])


def _canon_coded(name: Digest, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=LEVEL)
    for b in batches:
        canons = [canonical(t) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([name(c) for c in canons]), pa.array([z.compress(c) for c in canons], pa.binary())], ["doc_id", "digest", "z"])


def forms(docs: DataFrame, name: Digest = digest) -> DataFrame:
    """digest, z (frame of the canonical form), first_id, n_docs. Equal frames
    are equal canonical bytes: one compressor, one level."""
    coded = docs.select("doc_id", "text").mapInArrow(partial(_canon_coded, name), "doc_id long, digest string, z binary")
    return coded.groupBy("digest", "z").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs"))


def classes(forms: DataFrame) -> DataFrame:
    """digest, n_texts (different canonical forms of that digest), first_id, n_docs."""
    return forms.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first_id").alias("first_id"), F.sum("n_docs").alias("n_docs"))


def edit(text: str, following: str) -> str:
    """The last quarter replaced by the start of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


FACTS = "doc_id long, n_chars long, edited_sha256 string, digest string, own_check long, edited_digest string, edited_check long, same_edited boolean, same_next boolean, own_z binary, edited_z binary, side int, part int, z binary"
FACT_NAMES = [x.split()[0] for x in FACTS.split(", ")]
FACT_KINDS = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in FACTS.split(", ")]


def _facts(name: Digest, framed: bool, doc_id, text: str, following: str) -> tuple:
    """``framed``: with the canonical forms as frames, for texts whose digests clash."""
    edited = edit(text, following)
    c, e, n = canonical(text), canonical(edited), canonical(following)
    frames = [zstandard.ZstdCompressor(level=LEVEL).compress(x) for x in (c, e)] if framed else [None, None]
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), name(c), check(c), name(e), check(e), c == e, c == n, *frames, 0, None, None)


def _neighbours(name: Digest, framed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: facts for each row but the last, which waits
    for the first row of the next range; both ends are passed on (side 1 and 2)."""
    from pyspark import TaskContext

    part, d = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
    batch_of = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), FACT_KINDS)], FACT_NAMES)
    last = None
    for b in batches:
        out, held = [], 0
        for doc_id, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = d.decompress(z).decode("utf-8", "surrogatepass")
            if last is None:
                out.append((doc_id, *[None] * 10, 1, part, z))
            else:
                out.append(_facts(name, framed, last[0], last[1], text))
            last, held = (doc_id, text, z), held + 1
            if held % 2000 == 0:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)
    if last is not None:
        yield batch_of([(last[0], *[None] * 10, 2, part, last[2])])


def _ends(name: Digest, framed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = zstandard.ZstdDecompressor()
    for b in batches:
        rows = [_facts(name, framed, i, d.decompress(z).decode("utf-8", "surrogatepass"), d.decompress(n).decode("utf-8", "surrogatepass")) for i, z, n in zip(*[c.to_pylist() for c in b.columns])]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), FACT_KINDS)], FACT_NAMES)


def _all_facts(docs: DataFrame, name: Digest, framed: bool) -> DataFrame:
    coded = docs.mapInArrow(_coded, "doc_id long, z binary").withColumn("h", F.xxhash64("z"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = coded.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "z").select("doc_id", "z")
    facts = materialize(ranged.mapInArrow(partial(_neighbours, name, framed), FACTS), "fingerprint-facts")
    # As many rows as ranges: the next range that has rows, the first after the last.
    tails = facts.where("side = 2").select("part", "doc_id", "z")
    heads = facts.where("side = 1").select("part", F.col("z").alias("next_z"))
    order = Window.orderBy("part")
    follow = heads.select("part").withColumn("to", F.lead("part").over(order)).withColumn("to", F.coalesce("to", F.min("part").over(Window.partitionBy())))
    pairs = tails.join(follow, "part").join(heads.withColumnRenamed("part", "to"), "to").select("doc_id", "z", "next_z")
    ends = pairs.mapInArrow(partial(_ends, name, framed), FACTS)
    return facts.where("side = 0").unionByName(ends).drop("side", "part", "z")


def fingerprint(docs: DataFrame, name: Digest = digest) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, class_first_id, class_docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = _all_facts(docs, name, False)
    found = materialize(classes(forms(docs, name)), "fingerprint-classes")
    # Different texts under one digest, by the bytes of documents or by the second digest.
    checks = facts.select("digest", F.col("own_check").alias("c")).unionByName(facts.select(F.col("edited_digest").alias("digest"), F.col("edited_check").alias("c")))
    apart = checks.groupBy("digest").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("digest")
    clash = found.where("n_texts > 1").select("digest").unionByName(apart).distinct()
    own, edited = F.col("digest"), F.col("edited_digest")
    if clash.limit(1).count():
        facts, clash = _all_facts(docs, name, True), materialize(clash, "fingerprint-clashes")
        every = facts.select("digest", F.col("own_z").alias("z")).unionByName(facts.select(F.col("edited_digest").alias("digest"), F.col("edited_z").alias("z"))).distinct()
        # They get ordinals by their bytes.
        ordinal = F.row_number().over(Window.partitionBy("digest").orderBy("z")) - 1
        told = materialize(every.join(clash, "digest").select("digest", "z", ordinal.alias("nth")), "fingerprint-ordinals")
        of = lambda d, z, n: told.select(F.col("digest").alias(d), F.col("z").alias(z), F.col("nth").alias(n))
        facts = facts.join(of("digest", "own_z", "own_nth"), ["digest", "own_z"], "left").join(of("edited_digest", "edited_z", "edited_nth"), ["edited_digest", "edited_z"], "left")
        numbered = lambda d, n: F.when(F.col(n) > 0, F.concat_ws("-", d, n)).otherwise(F.col(d))
        own, edited = numbered("digest", "own_nth"), numbered("edited_digest", "edited_nth")
    return facts.join(found, "digest", "left").select(
        "doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), edited.alias("edited_fingerprint"),
        F.col("same_edited").cast("double").alias("near_edited"),
        F.col("same_next").cast("double").alias("near_next"),
        F.col("first_id").alias("class_first_id"), F.col("n_docs").alias("class_docs"),
    )


def op10_fingerprints(spark, sf_dir):
    from .common import table

    return fingerprint(table(spark, sf_dir, "documents"))
