"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a seeded shuffle, again and again up to
``epochs`` times. A queued copy finishes at (words of its source up to and
including it) / (target of its source); all queues are merged by finish time and
cut where the words taken reach the total budget.

Targets: weights 5, 2, 1 repeating over the sources in code point order (null
last) share the budget; a target stops at ``epochs`` times its source's words,
and the excess is shared again by weight until no target is above.

Defined results: null or blank texts have size 0 and are never taken; an empty
table gives an empty table; sources of no words have target 0; null doc_ids shuffle
as "~", with a digest of their texts; ties of finish times go by source, then by
shuffle; repeated rows are separate documents; a very long text is one document, taken
whole or not at all; extra columns are ignored (``mix_rows`` keeps them).

Scale: narrow rows only; queue sums are prefix sums over buckets, so neither a
hot source nor the merged order has to fit into one task. The table of sources
(one row each) is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets_for, materialize, null_last_key, prefix_rank, seeded, table, unit, unused

EPOCHS, SEED, WEIGHTS = 3, "mix-1", (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """key, source_size -> key, source_size, target. Water-filling in closed form:
    in the order of cap / weight a source is capped while the level that the
    uncapped rest would get is above its own."""
    everything = Window.partitionBy()
    by_key = Window.orderBy("key")
    n = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_key) - 1) % n + 1).cast("int"))
    t = sizes.select("key", "source_size").withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    t = t.withColumn("capped", F.col("cap") / F.col("weight") <= level)
    free = F.when(~F.col("capped"), F.col("weight"))
    held = F.when(F.col("capped"), F.col("cap")).otherwise(0)
    t = t.withColumn("level", (F.col("total") - F.sum(held).over(everything)).cast("double") / F.sum(free).over(everything))
    return t.select("key", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _queued(docs: DataFrame, seed: str, extra: list[str]) -> DataFrame:
    return docs.select(
        *extra,
        F.col("doc_id").cast("long").alias("doc_id"),
        null_last_key(F.col("source")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded(seed, F.col("doc_id"), F.md5(F.col("text").cast("binary"))).alias("shuffled"),
    )


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (and the columns in ``extra``)."""
    rows = materialize(_queued(docs, seed, list(extra)), "mix-rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    b = buckets_for(n)
    goals = targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), epochs)
    queue = prefix_rank(rows, ["key"], F.floor(unit(F.col("shuffled")) * b), ["shuffled", "doc_id", "size", *extra], "place", "size", "upto")
    queue = materialize(queue.join(goals, "key"), "mix-queue")
    copies = queue.where("size > 0").select("key", "place", "size", "shuffled", "source_size", "target", "upto", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")).withColumn("all", F.lit(0))
    merged = prefix_rank(copies, ["all"], F.floor(F.col("finish") * b), ["finish", "key", "shuffled", "epoch", "place"], "turn", "size", "words")
    taken = merged.where(F.col("words") <= total).groupBy("key", "place").agg(F.sum("size").alias("taken"), F.count(F.lit(1)).alias("copies"))
    out = queue.join(taken, ["key", "place"], "left")
    return out.select(*extra, "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(md5(text), '~')) AS shuffled
  FROM documents
), sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY key),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS weight, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total FROM sources
), levels AS (
  SELECT *, cap / weight <= (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM weighted
), goals AS (
  SELECT key, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE / sum(CASE WHEN NOT capped THEN weight END) OVER () * weight END AS target FROM levels
), queue AS (
  SELECT r.*, g.source_size, g.target, row_number() OVER w AS place, sum(r.size) OVER w AS upto FROM rows_ r JOIN goals g USING (key)
  WINDOW w AS (PARTITION BY r.key ORDER BY shuffled, doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), copies AS (
  SELECT key, place, size, sum(size) OVER (ORDER BY (epoch * source_size + upto)::DOUBLE / target, key, shuffled, epoch, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words
  FROM queue, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0
), taken AS (
  SELECT key, place, sum(size)::BIGINT AS taken, count(*)::INTEGER AS copies FROM copies WHERE words <= (SELECT sum(size) FROM rows_) GROUP BY key, place
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(copies, 0) AS copies FROM queue LEFT JOIN taken USING (key, place)
"""


def mix_rows(docs: DataFrame, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves (all columns), each as often as it is taken;
    columns may have any names. Of rows with one doc_id, text and source the first
    stands for all."""
    row_, id_, copies_, nth_, copy_ = unused(docs.columns, "_row", "_id", "_copies", "_nth", "_copy")
    row = F.xxhash64("doc_id", "text", "source").alias(row_)
    taken = mix(docs.select("doc_id", "text", "source", row), epochs, seed, (row_,)).groupBy(row_, F.col("doc_id").alias(id_)).agg(F.sum("copies").cast("int").alias(copies_))
    taken = materialize(taken.where(F.col(copies_) > 0), "mix-taken")
    # One exchange of the rows serves the window and the join.
    nth = F.row_number().over(Window.partitionBy(row_, "doc_id").orderBy("source"))
    first = docs.select("*", row).hint("merge").join(taken, row_).where(F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    first = first.withColumn(nth_, nth).where(F.col(nth_) == 1)
    return first.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(copies_)))).select(*docs.columns)
