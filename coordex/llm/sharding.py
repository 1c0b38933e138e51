"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows of each source are shuffled by a seeded md5 and ranked; the fractional rank
(rank - 1/2) / rows of the source orders all sources together, and the ordered
rows are cut into shards whose row counts differ by one at most (law ``rows``).
Any run of consecutive rows holds each source in proportion, so every shard
matches the mixture.

Defined results: a null text has no bytes (size 16); a null source is a stratum
of its own, last in order; null doc_ids shuffle as "~", with their texts' checksums,
so that many of them are spread; ties of the fractional rank go by source, then by
shuffle; repeated rows are ranked one after the other; a text of any length is its
size and checksum only; an empty table gives an empty table; extra columns are
ignored.

Scale: only narrow rows (no text) are shuffled, by (source, bucket of the
shuffle) and by buckets of the fractional rank, so a source that holds a third
of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialize, null_last_key, prefix_rank, seeded, table, unit

SHARDS, SEED = 40, "shard-1"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source, source_rank, position."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            null_last_key(F.col("source")).alias("key"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        ).withColumn("shuffled", seeded(seed, F.col("doc_id"), F.col("text_crc32"))),
        "shard-rows",
    )
    n = rows.count()
    b = buckets_for(n)
    ranked = prefix_rank(rows, ["key"], F.floor(unit(F.col("shuffled")) * b), ["shuffled", "doc_id", "text_crc32", "size"], "source_rank")
    totals = rows.groupBy("key").agg(F.count(F.lit(1)).alias("source_rows"))
    # Totals: a row per source; small or large, Spark picks the join by measured size.
    ranked = ranked.join(totals, "key").withColumn("fraction", (F.col("source_rank") - 0.5) / F.col("source_rows"))
    placed = prefix_rank(
        ranked.withColumn("all", F.lit(0)), ["all"], F.floor(F.col("fraction") * b), ["fraction", "key", "shuffled", "doc_id", "text_crc32", "size"], "place"
    )
    at = F.col("place") - 1
    shard = F.expr(f"((place - 1) * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("long"))
        .withColumn("slot", at - first)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "source_rank", at.alias("position"))
    )


def op4_sharding(spark, sf_dir):
    return interleave(table(spark, sf_dir, "documents")).drop("source", "source_rank", "position")


#: crc32 by its definition: the reflected polynomial, a table of 256 made by rule.
ORACLE = """
WITH RECURSIVE crc_steps(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents
), rows_ AS (
  SELECT doc_id, octet_length(encode(text)) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32,
    CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS key,
    md5('shard-1:' || coalesce(doc_id::VARCHAR, '~') || ':' || text_crc32::VARCHAR) AS shuffled
  FROM bytes, crc_table
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY key ORDER BY shuffled, doc_id NULLS FIRST, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY key) AS fraction FROM rows_
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, key, shuffled, doc_id NULLS FIRST, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((place * 40) // n AS INTEGER) AS shard,
  place - (((place * 40) // n) * n + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
