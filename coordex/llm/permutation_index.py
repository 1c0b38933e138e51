"""Approximate nearest neighbours with a permutation index.

Pivots are a sample of the vectors, ``PIVOTS`` of them and more where the table is
large (they grow with the square root of its size, to ``MOST_PIVOTS``). Each vector is
represented by its ``PREFIX`` nearest pivots in order, and posted in the inverted files
of the first ``POST`` of them. A query reads the files of its own first ``PROBE`` pivots,
and of each file the vectors that it has not met in an earlier one. They are ranked by
the footrule distance of the orders (a pivot that is missing stands at ``PREFIX``), and
those up to the distance of the best share of the file, ties included, are
reranked by the exact cosine in double precision. ``exact=True`` is the way without
loss: each vector stands in the file of its nearest pivot alone, a query reads all
files and reranks all they hold.

The share is measured on the table itself: for ``PROBES`` sampled vectors the true
neighbours are found by a scan of all, then which share of its file has to be reranked to
reach each; the share that reaches ``AIM`` of them, and MARGIN times as much, is taken. It
falls as the table grows, as neighbours come closer, and is higher where they are hard to tell.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do vectors of another dimension than the most
frequent one (ties: the smaller); repeated vectors are indexed once and answer
with their least ids; a vec_id that is repeated is asked once and answers once,
at the best cosine of its vectors; null vec_ids take no part; fewer candidates
than ``k`` give them all; an empty table gives an empty table; extra columns are
ignored. Columns of text are not read, so their length is of no account.

Scale: index and queries meet by pivot, so a vector moves ``POST`` times and a query
``PROBE`` times, whatever the size of the table; a file of more than ``FILE_BLOCK``
vectors is dealt over blocks (a cluster around one pivot may hold a third of all),
one of more than ``QUERY_BLOCK`` queries likewise. Equal vectors are folded before
anything moves (only their k + 1 least ids can answer), so a vector that fills a
third of the table is one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

PIVOTS, PREFIX, POST, PROBE = 128, 32, 8, 24
MOST_PIVOTS, MOST_PREFIX, GROWTH = 1024, 64, 0.57
LEAST = 64
PROBES, AIM, MARGIN = 40, 0.96, 1.15
FILE_BLOCK, QUERY_BLOCK = 8192, 2048
K = 5


def usable(rows: DataFrame) -> DataFrame:
    """id, v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.withColumn("d", F.size("v")).join(F.broadcast(dims.select("d")), "d", "left_semi").drop("d")  # one row


def layout(vectors: int) -> tuple[int, int, int]:
    """How many pivots, how many of them in an order, how many files a query reads."""
    pivots = int(min(MOST_PIVOTS, max(PIVOTS, np.ceil(GROWTH * vectors**0.5))))
    prefix = min(MOST_PREFIX, max(PREFIX, pivots // 4))
    return pivots, prefix, prefix * PROBE // PREFIX


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each row (unit vectors), nearest first."""
    n = min(prefix, len(pivots))
    near = x @ pivots.T
    top = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(pivots) else np.tile(np.arange(n), (len(x), 1))
    sub = np.take_along_axis(near, top, 1)
    return np.take_along_axis(top, np.lexsort((top, -sub), axis=1), 1)


def inverted(perms: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the rows that rank it, and where."""
    rows, at = np.divmod(np.arange(perms.size), perms.shape[1])
    flat = perms.ravel()
    by = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[by], np.arange(pivots + 1))
    return [(rows[by[a:b]], at[by[a:b]].astype(np.int32)) for a, b in zip(cuts[:-1], cuts[1:])]


def footrule(order: np.ndarray, files: list, rows: int) -> np.ndarray:
    """Distance of each posted row's order to this one, from the files of its pivots alone."""
    n = len(order)
    distance = np.full(rows, n * (n + 1), np.int32)
    for at, p in enumerate(order):
        who, where = files[p]
        distance[who] -= 2 * np.minimum(n - at, n - where)
    return distance


def search_file(ids: list, x: np.ndarray, perms: np.ndarray, q: np.ndarray, orders_: np.ndarray, at: np.ndarray, pivots: int, k: int, share: float, post: int) -> list[list[tuple[int, float]]]:
    """For each query vector (its order, and which of its pivots this file is) the
    k + 1 best of this file: (vec_id, cosine), nearest first."""
    norms, sizes = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    files, posted, out = inverted(perms, pivots), perms[:, :post], []
    for v, size, order, nth in zip(q, sizes, orders_, at):
        met = np.zeros(pivots, bool)
        met[order[:nth]] = True
        live = np.flatnonzero(~met[posted].any(1))
        keep = min(len(live), max(LEAST, int(np.ceil(share * len(live)))))
        if not keep:
            out.append([])
            continue
        near = live
        if keep < len(live):
            d = footrule(order, files, len(x))[live]
            near = live[d <= np.partition(d, keep - 1)[keep - 1]]
        score = (x[near] * v).sum(1) / (norms[near] * size)
        most = k + 1
        while True:
            best = score >= np.partition(score, len(score) - most)[len(score) - most] if len(score) > most else np.ones(len(score), bool)
            hits = {}
            for s, j in zip(score[best].tolist(), near[best].tolist()):
                for i in ids[j]:
                    hits[i] = max(s, hits.get(i, s))
            # Vectors that share ids: as many more as it takes for k + 1 ids.
            if len(hits) > k or best.all():
                break
            most *= 2
        out.append(sorted(hits.items(), key=lambda h: (-h[1], h[0]))[: k + 1])
    return out


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(rows, -1)


def ordered(rows: DataFrame, pivots: np.ndarray, prefix: int = PREFIX) -> DataFrame:
    """Adds ``perm``, the nearest pivots in order."""
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")
    at = rows.columns.index("v")

    def named(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = part.column(at).flatten().to_numpy().reshape(part.num_rows, -1)
                perms = orders(x / np.linalg.norm(x, axis=1, keepdims=True), pivots, prefix).astype(np.int16)
                cuts = pa.array(np.arange(len(x) + 1) * perms.shape[1], pa.int32())
                yield part.append_column("perm", pa.ListArray.from_arrays(cuts, pa.array(perms.ravel())))

    return rows.mapInArrow(named, f"{schema},perm:array<smallint>")


def placed(perms: np.ndarray, order: np.ndarray, pivots: int, post: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the file of the order's in which it is met first, and its footrule distance."""
    n = perms.shape[1]
    at = np.full(pivots, n)
    at[order] = np.arange(n)
    return at[perms[:, :post]].min(1), n * (n + 1) - 2 * (n - np.maximum(at[perms], np.arange(n))).sum(1)


def measured_share(index: DataFrame, pivots: int, probe: int, k: int = K, probes: int = PROBES, aim: float = AIM) -> float:
    """The share of a file that has to be reranked, from ``probes`` vectors of the index."""
    asked = index.orderBy(F.xxhash64(F.lit(29), "key"), "v").limit(probes).select("key", "v", "perm").collect()  # ``probes`` rows
    keys, q, perms = np.array([r.key for r in asked]), np.array([r.v for r in asked]), np.array([r.perm for r in asked])
    q /= np.linalg.norm(q, axis=1, keepdims=True)

    def opened(b: pa.RecordBatch):
        x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
        return b.column(0).to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)

    def top(batches):
        for b in batches:
            key, x, perm = opened(b)
            score = q @ x.T
            score[keys[:, None] == key[None]] = -2
            best = np.argsort(-score, 1, kind="stable")[:, :k]
            who = np.repeat(np.arange(len(q)), best.shape[1])
            cuts = pa.array(np.arange(len(who) + 1) * perm.shape[1], pa.int32())
            orders_ = pa.ListArray.from_arrays(cuts, pa.array(perm[best.ravel()].ravel().astype(np.int16)))
            yield pa.record_batch([pa.array(who), pa.array(np.take_along_axis(score, best, 1).ravel()), pa.array(key[best.ravel()]), orders_], ["who", "score", "key", "perm"])

    rank = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score"), "key"))
    near = index.select("key", "v", "perm").mapInArrow(top, "who long, score double, key long, perm array<smallint>")
    near = near.withColumn("r", rank).where((F.col("r") <= k) & (F.col("score") > -2)).orderBy("who", "r").collect()  # k rows a probe
    if not near:
        return 1.0
    goals = [(r.who, *(int(a[0]) for a in placed(np.array([r.perm], np.int64), perms[r.who], pivots, POST))) for r in near]

    def count(batches):
        below, held = np.zeros(len(goals), np.int64), np.zeros(len(goals), np.int64)
        for b in batches:
            key, _, perm = opened(b)
            for w in range(len(q)):
                first, d = placed(perm, perms[w], pivots, POST)
                own = key == keys[w]
                for g, (who, nth, far) in enumerate(goals):
                    if who == w:
                        same = (first == nth) & ~own
                        held[g] += same.sum()
                        below[g] += (same & (d <= far)).sum()
        yield pa.record_batch([pa.array(np.arange(len(goals))), pa.array(below), pa.array(held)], ["goal", "below", "held"])

    sums = index.select("key", "v", "perm").mapInArrow(count, "goal long, below long, held long").groupBy("goal").agg(F.sum("below").alias("below"), F.sum("held").alias("held"))
    found = {r.goal: r.below / r.held for r in sums.collect()}  # k rows a probe
    need = sorted(found[g] if nth < probe else 2.0 for g, (_, nth, _) in enumerate(goals))
    return min(1.0, MARGIN * need[min(len(need) - 1, int(aim * len(need)))])


def nearest(rows: DataFrame, queries: DataFrame | None = None, k: int = K, share: float | None = None, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score. Queries: the rows whose id is divisible by 50.
    share: of each file that is reranked; by default as measured."""
    spark = rows.sparkSession
    rows = materialize(usable(rows).withColumn("key", F.xxhash64("v")), "ann-rows")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = materialize(rows.distinct(), "ann-distinct")
    # Equal vectors fold; a window limit is applied before and after the shuffle.
    least = Window.partitionBy("key", "v").orderBy("id")
    folded = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    folded = materialize(folded, "ann-vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    most_pivots, prefix, probe = layout(folded.count())
    chosen = [r.v for r in folded.orderBy(F.xxhash64(F.lit(17), "key"), "v").limit(most_pivots).collect()]  # at most MOST_PIVOTS rows
    if not chosen:
        return spark.createDataFrame([], schema)
    pivots = np.array(chosen)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    n = len(pivots)
    asked = rows.where("id % 50 = 0") if queries is None else usable(queries).withColumn("key", F.xxhash64("v"))
    asked = materialize(asked.select(F.col("id").alias("query_id"), "key", "v").distinct(), "ann-queries")
    vectors = asked.select("key", "v").distinct().withColumn("qid", F.monotonically_increasing_id())
    index, vectors = (materialize(ordered(t, pivots, prefix), name) for t, name in ((folded, "ann-index"), (vectors, "ann-query-vectors")))
    post = 1 if exact else POST
    posted = index.select("key", "ids", "v", "perm", F.explode(F.slice("perm", 1, post)).alias("pivot")).withColumn("pivot", F.col("pivot").cast("int"))
    read = F.sequence(F.lit(0), F.lit(n - 1)) if exact else F.slice("perm", 1, probe)
    probed = vectors.select("qid", "v", "perm", F.posexplode(read).alias("nth", "pivot")).withColumn("pivot", F.col("pivot").cast("int"))

    def parts(t: DataFrame, block: int) -> Column:
        """How many blocks the rows of each pivot are dealt over: a number a pivot."""
        count = {r.pivot: r["count"] for r in t.groupBy("pivot").count().collect()}
        return F.element_at(F.array(*[F.lit(max(1, -(-count.get(p, 0) // block))) for p in range(n)]), F.col("pivot") + 1)

    blocks, qblocks = parts(posted, FILE_BLOCK), parts(probed, QUERY_BLOCK)
    spread = lambda c, m: F.pmod(F.xxhash64(F.lit(23), c), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    posted = posted.select("ids", "v", "perm", "pivot", spread("key", blocks).alias("ib"), every(qblocks).alias("qb"))
    probed = probed.select("qid", "v", "perm", "nth", "pivot", spread("qid", qblocks).alias("qb"), every(blocks).alias("ib"))
    most = 1.0 if exact else measured_share(index, n, probe, k) if share is None else share

    def search(block: pa.Table, probe: pa.Table) -> pa.Table:
        kinds = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not block.num_rows or not probe.num_rows:
            return kinds.empty_table()
        matrix = lambda t, c: _matrix(t.column(c), t.num_rows)
        at = np.zeros(probe.num_rows, int) if exact else probe.column("nth").to_numpy()
        found = search_file(block.column("ids").to_pylist(), matrix(block, "v"), matrix(block, "perm"), matrix(probe, "v"), matrix(probe, "perm"), at, n, k, most, post)
        hits = [(q, i, s) for q, f in zip(probe.column("qid").to_pylist(), found) for i, s in f]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*hits), kinds.types)], schema=kinds) if hits else kinds.empty_table()

    by = ["pivot", "ib", "qb"]
    hits = posted.groupBy(*by).cogroup(probed.groupBy(*by)).applyInArrow(search, "qid long, vec_id long, score double")
    hits = hits.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    named = asked.join(vectors.drop("perm"), ["key", "v"]).select("query_id", "qid")
    ranked = named.join(hits, "qid").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_permutation_index(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
