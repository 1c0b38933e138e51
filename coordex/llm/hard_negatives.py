"""Hard-negative mining by a two-dimensional block matrix product (SUMMA-style).

Rows and anchors are laid out by label and cut into blocks of ``ROWS`` and
``ANCHORS``; their vectors are cut into panels of ``CHUNK`` dimensions, in the narrowest
whole numbers. A cell of the grid is an anchor block and one of ``GROUPS`` groups of row
blocks. Its task holds the anchors' panels, lets those of the row blocks pass by, adds the
products of a pair of panels to the tile of a slice of anchors and reduces the whole tile
at once to the best few of each anchor: panels are shuffled, tiles and scores never are.
It is done twice: over the blocks that share a label, for each anchor's first ``positives``
rows of its own label, and over all blocks, for the first ``negatives`` rows of other
labels in the window of each anchor and positive.

A component x is floor(256 * x), x as double. A row's score is its inner product with
the anchor; higher scores come first, ties by smaller vec_id. The window of a positive
of score p holds scores s with 50 p <= 100 s <= 95 p.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite
component take no part; where vec_id is divisible by 7, label becomes (label + 1) % 10;
missing dimensions of a shorter vector count as 0, so an empty vector scores 0 with all;
rows that share a vec_id are rows of their own, and repeated rows are each other's
positives (they are folded, an anchor's result comes once for each repetition); no
positive or nothing in the window gives no row; an empty table gives an empty table;
extra columns, texts among them, are not read. Vectors whose squared length reaches
2^62 have no score of 64 bits: ArithmeticError.

Scale: every anchor is multiplied with every row, in blocks: that is the stated query
set against all rows, not a join of pairs. What moves grows with the rows: an anchor block
moves at most ``GROUPS`` times, a row block once for each anchor block (one up to 819,200
rows). A task holds an anchor block (``PANEL_BYTES``), a row block and a tile of ``SLICE``
anchors (4 MB), whatever the size of a label; a hot label is spread over blocks by a hash.
Best rows are merged in each task before they move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets_for, materialize, prefix_rank, table

ROWS, ANCHORS, CHUNK = 2048, 16384, 32
#: Anchors of a block whose tile is in memory at once, and groups of row blocks that an anchor block meets.
SLICE, GROUPS = 256, 24
#: Bytes of an anchor block's vectors, as 64-bit numbers.
PANEL_BYTES = 32 << 20
EVERY, POSITIVES, NEGATIVES = 50, 5, 3
NONE = -(1 << 62)

_PANEL = "block long, chunk int, many int, wide int, places binary, ids binary, labels binary, wins binary, panel binary"
_FOUND = "place long, at long, found_id long, found_score long"


def finite(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite; null for a null vector."""
    big = F.lit(float("inf"))
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big))


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def placed(embeddings: DataFrame, positives: int = POSITIVES) -> DataFrame:
    """place (from 0, by label), vec_id, label, v, copy, times. Equal rows are folded:
    ``times`` counts them and up to positives + 1 copies take places."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    folded = rows.select(vec_id.alias("vec_id"), label.alias("label"), quantised(F.col("embedding")).alias("v")).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("times"))
    rows = materialize(folded.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least("times", F.lit(positives + 1)).cast("int") - 1))), "negatives-rows")
    n = buckets_for(rows.count())
    at = F.col("label") * n + F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    ranked = prefix_rank(rows.withColumn("_all", F.lit(0)), ["_all"], at, ["vec_id", "v", "copy"], "place")
    return materialize(ranked.drop("_all").withColumn("place", F.col("place") - 1), "negatives-placed")


def _padded(lists: pa.ListArray, wide: int) -> np.ndarray:
    out = np.zeros((len(lists), wide), np.int64)
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _narrow(v: np.ndarray) -> np.ndarray:
    least, most = v.min(initial=0), v.max(initial=0)
    return v.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def panels(rows: DataFrame, chunk: int) -> DataFrame:
    """rows: block, place, vec_id, label, wins, v -> a panel for each block and chunk, in
    order of places; the first one has the block's ids. wins: positive_id and score, best first."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        lists = t.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        wide = max(1, int(np.diff(lists.offsets.to_numpy()).max()))
        v = _padded(lists, wide)
        wins = t.column("wins").to_pylist()
        most = max((len(w) for w in wins), default=0)
        held = np.full((t.num_rows, most, 2), NONE, np.int64)
        for k, w in enumerate(wins):
            for p, x in enumerate(w):
                held[k, p] = x["positive_id"], x["score"]
        meta = [t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("place", "vec_id", "label")] + [held.tobytes()]
        cuts = range(0, wide, chunk)
        many, block = len(cuts), t.column("block")[0].as_py()
        cols = [[block] * many, list(range(many)), [t.num_rows] * many, [min(chunk, wide - c) for c in cuts], *[[m] + [b""] * (many - 1) for m in meta], [np.ascontiguousarray(_narrow(v[:, c : c + chunk])).tobytes() for c in cuts]]
        kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["block", "chunk", "many", "wide", "places", "ids", "labels", "wins", "panel"])

    able = rows.select("block", "place", "vec_id", "label", "wins", "v")
    return materialize(able.groupBy("block").applyInArrow(pack, _PANEL), "negatives-panels")


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of whole numbers, exact: in doubles while all sums stay below 2^53."""
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if top(x) * top(y) * x.shape[1] < 1 << 53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def _matrix(row: dict) -> np.ndarray:
    """A panel of whole numbers, in the narrowest kind that holds them."""
    size = len(row["panel"]) // max(1, row["many"] * row["wide"])
    return np.frombuffer(row["panel"], f"i{size or 8}").reshape(row["many"], row["wide"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks with their panels in the order of the chunks; rows come sorted by a, g, b, chunk."""
    held = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held is None or any(held[c] != row[c] for c in "agb"):
                if held is not None:
                    yield held
                held = row | {c: np.frombuffer(row[c], np.int64) for c in ("places", "ids", "labels", "wins")} | {"panels": []}
            held["panels"].append(_matrix(row))
    if held is not None:
        yield held


def _norm(panels: list[np.ndarray]) -> float:
    return float(np.sqrt(sum((x.astype(float) ** 2).sum(1) for x in panels).max(initial=0)))


def _merge(score: np.ndarray, name: np.ndarray, at: np.ndarray, new_score: np.ndarray, new_name: np.ndarray) -> None:
    """Puts new scores and ids of the lines ``at`` among the best ones of each line."""
    k = score.shape[1]
    lines, count = np.unique(at, return_counts=True)
    at = np.concatenate([np.repeat(lines, k), at])
    s, n = np.concatenate([score[lines].ravel(), new_score]), np.concatenate([name[lines].ravel(), new_name])
    order = np.lexsort((n, -s, at))
    first = np.cumsum(count + k) - (count + k)
    take = order[(first[:, None] + np.arange(k)).ravel()]
    score[lines], name[lines] = s[take].reshape(-1, k), n[take].reshape(-1, k)


def _kth(tile: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score that fits, line by line; NONE where fewer fit."""
    if tile.shape[1] < k:
        return np.full(len(tile), NONE)
    return np.partition(np.where(fits, tile, NONE), -k, axis=1)[:, -k]


class _Best:
    """The best k rows of each line and window of one slice of anchors: scores from low to
    high, of rows of the same label (own) or another one."""

    def __init__(self, block: dict, cut: slice, low: np.ndarray, high: np.ndarray, k: int, own: bool):
        self.places, self.labels, self.low, self.high, self.own = block["places"][cut], block["labels"][cut], low, high, own
        self.panels = [p[cut] for p in block["panels"]]
        self.norm = _norm(self.panels)
        self.score, self.name = np.full((*low.shape, k), NONE), np.full((*low.shape, k), np.iinfo(np.int64).max)

    def fits(self, block: dict, r, c) -> np.ndarray:
        same = self.labels[r] == block["labels"][c]
        return same & (self.places[r] != block["places"][c]) if self.own else ~same

    def add(self, block: dict) -> None:
        if self.norm * block["norm"] >= 2.0**62:
            raise ArithmeticError("an inner product needs more than 64 bits")
        if self.own and (block["labels"].min() > self.labels.max() or block["labels"].max() < self.labels.min()):
            return
        tile = np.zeros((len(self.places), len(block["ids"])), np.int64)
        for x, y in zip(self.panels, block["panels"]):
            wide = min(x.shape[1], y.shape[1])
            tile += product(x[:, :wide], y[:, :wide])
        floor = np.maximum(self.low, self.score[:, :, -1])
        inside = (tile >= floor.min(1)[:, None]) & (tile <= self.high.max(1)[:, None])
        if np.count_nonzero(inside) > 32 * len(tile):  # a first look: only the block's own best can count
            every = self.fits(block, np.arange(len(tile))[:, None], np.arange(tile.shape[1])[None])
            for p in range(floor.shape[1]):
                window = every & (tile >= floor[:, p, None]) & (tile <= self.high[:, p, None])
                floor[:, p] = np.maximum(floor[:, p], _kth(tile, window, self.score.shape[2]))
            inside &= every & (tile >= floor.min(1)[:, None])
        r, c = np.nonzero(inside)
        able = self.fits(block, r, c)
        r, c = r[able], c[able]
        s, n = tile[r, c], block["ids"][c]
        for p in range(floor.shape[1]):
            last, name = self.score[r, p, -1], self.name[r, p, -1]
            on = (s >= floor[r, p]) & (s <= self.high[r, p]) & ((s > last) | ((s == last) & (n < name)))
            if on.any():
                _merge(self.score[:, p], self.name[:, p], r[on], s[on], n[on])

    def found(self) -> pa.RecordBatch:
        r, p, c = np.nonzero(self.score != NONE)
        cols = [self.places[r], p.astype(np.int64), self.name[r, p, c], self.score[r, p, c]]
        return pa.record_batch([pa.array(x) for x in cols], ["place", "at", "found_id", "found_score"])


def _best_of(k: int, own: bool):
    """The best k rows of each anchor of a cell: of its own label, or of other labels in the
    window of each of its positives. The anchors' block comes first (b is -1) and stays, the
    blocks of rows pass by."""

    def slices(block: dict) -> Iterator[_Best]:
        many = len(block["ids"])
        low, high = np.full((many, 1), NONE + 1), np.full((many, 1), -NONE)
        if not own:
            # 50 p <= 100 s <= 95 p in whole numbers: s from ceil(p / 2) to floor(19 p / 20); big scores without overflow
            top = block["wins"].reshape(many, -1, 2)[:, :, 1]
            low = np.where(top == NONE, -NONE, -(-top // 2))
            high = np.where(top == NONE, NONE, top // 20 * 19 + top % 20 * 19 // 20)
        for start in range(0, many, SLICE):
            cut = slice(start, start + SLICE)
            yield _Best(block, cut, low[cut], high[cut], k, own)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Best] = []
        for block in _blocks(batches):
            if block["b"] < 0:
                yield from (h.found() for h in held)
                held = list(slices(block))
                continue
            block["norm"] = _norm(block["panels"])
            for h in held:
                h.add(block)
        yield from (h.found() for h in held)

    return fn


def _between(blocks: DataFrame, low: Column, high: Column) -> DataFrame:
    """blocks: a -> a, b for every b from low to high, by thousands first, so that no row lists them all."""
    thousands = blocks.select("a", low.alias("_low"), high.alias("_high")).withColumn("_k", F.explode(F.sequence(F.expr("_low div 1024"), F.expr("_high div 1024"))))
    return thousands.select("a", F.explode(F.sequence(F.greatest(F.col("_low"), F.col("_k") * 1024), F.least(F.col("_high"), F.col("_k") * 1024 + 1023))).alias("b"))


def _cells(anchors: DataFrame, rows: DataFrame, meets: DataFrame, group: int, parts: int) -> DataFrame:
    """The panels of each cell in one task: an anchor block and the row blocks of one group
    that it meets (a, b), by a, g, b and chunk."""
    meets = meets.withColumn("g", F.expr(f"b div {group}"))
    left = anchors.withColumnRenamed("block", "a").join(meets.select("a", "g").distinct(), "a").withColumn("b", F.lit(-1).cast("long"))
    right = rows.withColumnRenamed("block", "b").join(meets, "b")
    return left.unionByName(right).repartition(parts, "a", "g").sortWithinPartitions("a", "g", "b", "chunk")


def mine(
    embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, rows: int = ROWS, anchors: int = ANCHORS, chunk: int = CHUNK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    able = placed(embeddings, positives)
    seen = able.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    last, wide = max(-(-seen[0] // rows) - 1, 0), max(seen[1] or 0, 1)
    anchors = min(anchors, max(SLICE, PANEL_BYTES // (8 * wide)))
    group = -(-(last + 1) // GROUPS)

    no_wins = F.array().cast("array<struct<positive_id:long,score:long>>").alias("wins")
    row_panels = panels(able.select(F.expr(f"place div {rows}").alias("block"), "place", "vec_id", "label", no_wins, "v"), chunk)
    asked = able.where((F.col("vec_id") % every == 0) & (F.col("copy") == 0)).withColumn("_all", F.lit(0))
    asked = prefix_rank(asked, ["_all"], F.expr("place div 100000"), ["place"], "nth").withColumn("block", F.expr(f"(nth - 1) div {anchors}"))
    asked = materialize(asked.drop("_all", "nth", "copy"), "negatives-anchors")
    parts = 2 * GROUPS * (asked.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1)

    # Labels lie together, so an anchor block meets its own labels in a range of row blocks.
    spans = able.groupBy("label").agg(F.expr(f"min(place) div {rows}").alias("b0"), F.expr(f"max(place) div {rows}").alias("b1"))
    spans = asked.select("block", "label").distinct().join(spans, "label").groupBy(F.col("block").alias("a")).agg(F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    meets = materialize(_between(spans, F.col("b0"), F.col("b1")), "negatives-cells")
    found = _cells(panels(asked.withColumn("wins", no_wins), chunk), row_panels, meets, group, parts).mapInArrow(_best_of(positives, True), _FOUND)
    best = Window.partitionBy("place").orderBy(F.desc("found_score"), "found_id")
    wins = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    wins = wins.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "found_id", "found_score"))), lambda x: F.struct(x["found_id"].alias("positive_id"), x["found_score"].alias("score"))).alias("wins"))
    able_anchors = materialize(asked.join(wins, "place"), "negatives-asked")

    meets = _between(able_anchors.select(F.col("block").alias("a")).distinct(), F.lit(0).cast("long"), F.lit(last).cast("long"))
    found = _cells(panels(able_anchors, chunk), row_panels, materialize(meets, "negatives-cells"), group, parts).mapInArrow(_best_of(negatives, False), _FOUND)
    best = Window.partitionBy("place", "at").orderBy(F.desc("found_score"), "found_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = able_anchors.select("place", F.col("vec_id").alias("anchor_id"), "times", "wins")
    win = F.get("wins", F.col("at").cast("int"))
    again = found.join(named, "place").withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return again.select("anchor_id", win["positive_id"].alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), win["score"].alias("positive_score"), F.col("found_score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir):
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
