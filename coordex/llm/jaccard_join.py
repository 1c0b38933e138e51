"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles (a text of one to four words is one
shingle of them all). Copies (equal words in order) are folded into one node.
Nodes carry a fixed-length min-wise sketch; a node of the path tree chooses a
few of the sketch's tokens by a hash of its path, and a set goes on to every
chosen token that it holds, so similar sets share paths. Buckets of ``SMALL``
or fewer are compared all with all on sketches, with a threshold low enough to
lose no pair; larger ones are split again, unless their members are alike on the
whole (two of them agree in ALIKE of the coordinates, which counts of random
bits tell) or ``DEPTH`` is reached: such a bucket is joined to candidates as a
whole. The whole is repeated in as many
runs as the target recall needs. Candidates form components, whose members are
compared exactly on their whole shingle sets, in blocks of so many nodes and
shingles, so that no task holds more than two blocks; counts of links and a
spanning forest come out, never pairs.

Result: doc_id, class_id (least doc_id of the class: documents joined by links),
n_links (other documents with a similarity of THRESHOLD or more, copies
counted), copies.

Defined results: null, empty and blank texts have no shingles and no links, each
row is a class of its own; repeated rows are copies of each other; a null doc_id
takes part and never names a class that has another; repeated doc_ids are rows of
their own; a very long text is one node with all its shingles (a block may hold it
alone); an empty table gives an empty table; extra columns are ignored.

Scale: rows are known by two hashes of their words in order, never by a doc_id that
may be null or repeated. Counts of a path are written before they are joined to its
rows, so Spark can split the rows of a hot path. Comparison inside a component
grows with the square of its different texts, a task for each pair of blocks: the
links of each document are counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rebatched, table, unused
from .components import components

THRESHOLD, WORDS = 0.8, 5
SKETCH, CHOSEN = 64, 2.0
SMALL, DEPTH, RECALL = 128, 5, 0.9999
SIGNS, ALIKE = 32, 0.5
#: Of sketches: five standard deviations below the threshold (0.05 each).
LOOSE = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
_R = np.random.default_rng(9)
SUBST = _R.integers(1, 1 << 63, 256, dtype=np.uint64)
SEEDS = _R.integers(1, 1 << 31, SKETCH, dtype=np.uint32)
FACTORS = _R.integers(1, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold is met with that probability: at each
    level a pair shares a Poisson number of chosen tokens, CHOSEN * threshold on
    average, and one of them has to lead on."""
    met = 1.0
    for _ in range(DEPTH):
        met = 1 - math.exp(-CHOSEN * threshold * met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, how many each has, and two words of
    64 bits that stand for each text's words in order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    blank = SPACE[data]
    edge = np.diff(np.concatenate([[1], blank.view(np.int8)]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = np.full(len(data) + 1, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(len(data) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(SUBST[data] * power[:-1], dtype=np.uint64)])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.concatenate([[0], ends_of[:-1]]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    # Sums of WORDS words with weights; short texts: one sum of all they have.
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    acc = np.zeros(len(word), np.uint64)
    for k in range(WORDS):
        acc += padded[k : k + len(word)] * np.uint64(pow(STEP, k, 1 << 64))
    have = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    begin = np.repeat(first, have)
    inside = np.arange(len(begin)) - np.repeat(np.cumsum(have) - have, have)
    out = mix(acc[begin + inside]) if len(begin) else np.zeros(0, np.uint64)
    at = np.cumsum(have) - have
    for i in np.flatnonzero((count > 0) & (count < WORDS)):
        own = word[first[i] : first[i] + count[i]]
        out[at[i]] = mix(np.array([sum(int(w) * pow(STEP, k, 1 << 64) for k, w in enumerate(own)) + int(count[i]) & (1 << 64) - 1], np.uint64))[0]
    place = np.arange(len(word)) - np.repeat(first, count)
    names = np.zeros((2, len(texts)), np.uint64)
    some = np.flatnonzero(count > 0)
    if len(some):
        for k in range(2):
            names[k, some] = np.add.reduceat(mix(word + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(k))), first[some])
    return out, have, names[0], names[1]


def sketches(hashes: np.ndarray, have: np.ndarray) -> np.ndarray:
    """SKETCH minima, a row a text that has shingles. All 32 bits: shorter values
    would make strangers share tokens as the corpus grows."""
    at = (np.cumsum(have) - have)[have > 0]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), SKETCH), np.uint32)
    for i in range(SKETCH):
        v = (low ^ SEEDS[i]) * FACTORS[i]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(v, at)
    return out


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rebatched(batches, "text", 1 << 20):
        hashes, have, x, y = shingles(_encoded(b.column(1)))
        rows = np.flatnonzero(have > 0)
        s = sketches(hashes, have) if len(rows) else np.zeros((0, SKETCH), np.uint32)
        sketch: list = [None] * len(have)
        for k, i in enumerate(rows.tolist()):
            sketch[i] = s[k].tobytes()
        yield pa.record_batch([b.column(0), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(have), pa.array(sketch, pa.binary())], ["doc_id", "x", "y", "n", "sketch"])


# ---- paths


def _choose(path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and new paths: the tokens that each path chooses and the row holds."""
    token = sketch.astype(np.uint64) | (np.arange(SKETCH, dtype=np.uint64) << np.uint64(32))
    h = mix(path[:, None] ^ mix(token * np.uint64(STEP)))
    row, at = np.nonzero(h < np.uint64(int(CHOSEN / SKETCH * (1 << 64))))
    return row, mix(h[row, at] + np.uint64(BASE))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _signs(sketch: np.ndarray) -> np.ndarray:
    """One random bit of each of SIGNS coordinates."""
    v = (sketch[:, :: SKETCH // SIGNS] * np.uint32(0x9E3779B1)) >> np.uint32(16) & np.uint32(1)
    return (v << np.arange(SIGNS, dtype=np.uint32)).sum(1).astype(np.int32)


def _rows(path: np.ndarray, ids: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    row, deeper = _choose(path, s)
    return pa.record_batch([pa.array(deeper.view(np.int64)), pa.array(ids[row]), pa.array(_signs(s)[row])], ["path", "node", "signs"])


def _roots(runs: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                ids, s = part.column(0).to_numpy(), _matrix(part.column(1))
                for r in range(runs):
                    yield _rows(np.full(len(s), mix(np.array([r + 1], np.uint64))[0]), ids, s)

    return fn


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 4096):
            part = b.slice(i, 4096)
            yield _rows(part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy(), _matrix(part.column(2)))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first columns, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        edges = [0, *cuts.tolist(), b.num_rows]
        for s, e in zip(edges[:-1], edges[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(like: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least numbers reachable over a table of links between two sides with the
    given numbers; the sides may be the same."""
    far = np.int64(1 << 62)
    while True:
        new_right = np.minimum(right, np.where(like, left[:, None], far).min(0, initial=far))
        new_left = np.minimum(left, np.where(like, new_right[None], far).min(1, initial=far))
        if np.array_equal(new_left, left) and np.array_equal(new_right, right):
            return left, right
        left, right = new_left, new_right


def _small_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for t in grouped(batches, 1):
        s = _matrix(t.column(2))
        ids = t.column(1).to_numpy()
        like = (s[:, None, :] == s[None, :, :]).sum(2) >= LOOSE * SKETCH
        roots = _forest(like, ids, ids)[0]
        away = np.flatnonzero(roots != ids)
        a += ids[away].tolist()
        b += roots[away].tolist()
        if len(a) > 50_000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def likeness():
    """Aggregate: how likely two members of a bucket agree in a coordinate. If a
    random bit of the coordinate is set in the share m of them, two disagree in
    it with 2 m (1 - m), half as often as in the coordinate itself."""
    shares = [F.avg(F.shiftright("signs", k).bitwiseAND(F.lit(1))) for k in range(SIGNS)]
    return sum((1 - 4 * m * (1 - m) for m in shares), F.lit(0.0)) / SIGNS


def candidates(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) that join all nodes which may be similar."""
    sketched, row = nodes.select("node", "sketch"), "path long, node long, signs int"
    # A node comes to a path once: paths are hashes of the path before and a token.
    level = materialize(sketched.mapInArrow(_roots(runs_for(recall)), row), "paths")
    edges = None
    for depth in range(1, DEPTH + 1):
        sizes = materialize(level.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1"), "path-sizes")
        live = materialize(level.join(sizes, "path"), "paths-shared")
        small = live.where(F.col("n") <= SMALL).select("path", "node").join(sketched, "node").select("path", "node", "sketch")
        found = small.repartition("path").sortWithinPartitions("path").mapInArrow(_small_buckets, "a long, b long")
        whole, split = live.where(F.col("n") > SMALL), None
        if depth < DEPTH:
            # Members that are alike on the whole: no split would part them.
            likes = materialize(whole.groupBy("path").agg(likeness().alias("like")), "path-likeness")
            split = whole.join(likes.where(F.col("like") < ALIKE), "path")
            whole = whole.join(likes.where(F.col("like") >= ALIKE), "path")
        found = found.unionByName(whole.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
        found = materialize(found, "path-edges")
        edges = found if edges is None else edges.unionByName(found)
        if split is None or not likes.where(F.col("like") < ALIKE).limit(1).count():
            break
        deeper = split.select("path", "node").join(sketched, "node").select("path", "node", "sketch")
        level = materialize(deeper.mapInArrow(_deeper, row), "paths")
    return edges


# ---- exact comparison inside components


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shingle sets of the nodes, each once a task."""
    seen: set[int] = set()
    for b in rebatched(batches, "text", 1 << 20):
        nodes, good = b.column(1).to_pylist(), []
        for i, node in enumerate(nodes):
            if node not in seen:
                seen.add(node)
                good.append(i)
        if not good:
            continue
        b = b.take(pa.array(good))
        hashes, have, _, _ = shingles(_encoded(b.column(0)))
        at = np.cumsum(have) - have
        sets = [np.unique(hashes[s : s + n]).tobytes() for s, n in zip(at, have)]
        yield pa.record_batch([*b.columns[1:], pa.array(sets, pa.binary())], ["node", "copies", "root", "block", "blocks", "shingles"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections, from blocks of an incidence matrix."""
    known, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    shared = np.bincount(inverse, minlength=len(known)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = row[keep], number[inverse][keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total, n, wide = np.zeros((len(left), len(right)), np.float32), int(shared.sum()), 2048
    for c in range(0, n, wide):
        a, b = np.searchsorted(col, [c, c + wide])
        m = np.zeros((len(left) + len(right), min(wide, n - c)), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group (root, i, j) of nodes: node, root in the group's forest, links."""
    node, root, links = [], [], []
    for t in grouped(batches, 3):
        i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
        held = dict(zip(t.column(3).to_pylist(), zip(t.column(4).to_pylist(), t.column(5).to_pylist(), t.column(6).to_pylist())))
        ids = sorted(held)
        sets = {k: np.frombuffer(held[k][2], np.uint64) for k in ids}
        left = [k for k in ids if held[k][1] == i]
        right = left if i == j else [k for k in ids if held[k][1] == j]
        if not left or not right or (i == j and len(left) < 2):
            continue
        n = lambda side: np.array([len(sets[k]) for k in side], np.float32)
        both = _overlaps([sets[k] for k in left], [sets[k] for k in right])
        # Whole numbers below 2^24 are exact; the margin is far below one shingle.
        like = both * np.float32(1 + THRESHOLD) >= np.float32(THRESHOLD) * (n(left)[:, None] + n(right)[None]) - np.float32(0.01)
        if i == j:
            np.fill_diagonal(like, False)
        copies = lambda side: np.array([held[k][0] for k in side], np.int64)
        roots = _forest(like, np.array(left), np.array(right))
        sides = [(left, like @ copies(right), roots[0])]
        if i != j:
            sides.append((right, like.T @ copies(left), roots[1]))
        for names, degree, tops in sides:
            some = np.flatnonzero(degree)
            node += [names[k] for k in some]
            root += tops[some].tolist()
            links += degree[some].tolist()
        if len(node) > 50_000:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (node, root, links)], ["node", "to", "links"])
            node, root, links = [], [], []
    yield pa.record_batch([pa.array(x, pa.int64()) for x in (node, root, links)], ["node", "to", "links"])


def no_id(c: Column) -> list[Column]:
    """A doc_id as two columns that are never null."""
    return [F.coalesce(c, F.lit(0)).alias("_id"), c.isNull().alias("_null")]


def _classed(docs: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, x, y, sketch per row; x, y, least, copies, root, class_id, links per text with words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(docs.mapInArrow(_profiles, "doc_id long, x long, y long, n long, sketch binary"), "join-profiles")
    nodes = rows.where("sketch is not null").groupBy("x", "y", "sketch").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.max("n").alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    likely = materialize(components(candidates(nodes, recall)).join(nodes.drop("sketch"), "node"), "join-likely")
    many = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    sizes = materialize(likely.groupBy("root").agg(F.ceil(many).cast("int").alias("blocks")), "join-sizes")
    placed = likely.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    asked = materialize(placed.select(*no_id(F.col("least")), F.col("x").alias("_x"), F.col("y").alias("_y"), "node", "copies", "root", "block", "blocks"), "join-asked")
    # Merged at any size: a broadcast of the asked would be for small inputs alone.
    texts = _worded(docs).where("_words").select("text", "_x", "_y", *no_id(F.col("doc_id"))).hint("merge").join(asked, ["_id", "_null", "_x", "_y"])
    texts = texts.select("text", "node", "copies", "root", "block", "blocks")
    sets = texts.mapInArrow(_sets, "node long, copies long, root long, block int, blocks int, shingles binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "shingles"
    )
    verdicts = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_compare, "node long, to long, links long")
    verdicts = materialize(verdicts, "join-links")
    classes = components(verdicts.select(F.col("node").alias("a"), F.col("to").alias("b")))
    degree = verdicts.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("sketch", "n").join(classes, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows, known.join(named, "root")


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copies per row."""
    rows, known = _classed(docs, recall)
    known = materialize(known.select("x", "y", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "join-classes")
    with_words = rows.where("sketch is not null").select("doc_id", "x", "y").join(known, ["x", "y"])
    none = rows.where("sketch is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return with_words.select("doc_id", "class_id", "n_links", "copies").unionByName(none)


def op9_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One document (all columns) of each class: the one that names it, or of a
    class without any doc_id the one whose words come first by hash. Repeated rows
    without words are one document. Columns may have any names."""
    from pyspark.sql.window import Window

    _, known = _classed(docs, recall)
    lead = F.min(F.struct(F.col("least").isNull(), "least", "x", "y")).alias("lead")
    keys = [*unused(docs.columns, "_id", "_null", "_x", "_y")]
    words, leads_, nth_ = unused([*docs.columns, *keys], "_words", "_leads", "_nth")
    named = [*no_id(F.col("lead.least")), F.col("lead.x"), F.col("lead.y")]
    leads = known.groupBy("root").agg(lead).select(*[c.alias(k) for c, k in zip(named, keys)], F.lit(True).alias(leads_))
    leads = materialize(leads, "join-leads")
    # One exchange on doc_id and words serves the join and the window.
    own = [c.alias(k) for c, k in zip(no_id(F.col("doc_id").cast("long")), keys)]
    worded = _worded(docs, *keys[2:], words).select("*", *own).hint("merge").join(leads, keys, "left")
    blank = F.when(~F.col(words), F.col("text").cast("string"))
    nth = F.row_number().over(Window.partitionBy(*keys, words, blank).orderBy("text"))
    kept = worded.where(F.col(leads_) | ~F.col(words)).withColumn(nth_, nth).where(F.col(nth_) == 1)
    return kept.select(*docs.columns)


def _worded(docs: DataFrame, x: str = "_x", y: str = "_y", words: str = "_words") -> DataFrame:
    """All columns, with what stands for the text's words and whether it has any."""
    from pyspark.sql.types import BooleanType, LongType, StructType

    schema = StructType([*docs.schema.fields]).add(x, LongType()).add(y, LongType()).add(words, BooleanType())
    at = docs.columns.index("text")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches, "text", 1 << 20):
            _, have, one, two = shingles(_encoded(b.column(at)))
            yield pa.record_batch([*b.columns, pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(have > 0)], [*b.schema.names, x, y, words])

    return docs.mapInArrow(named, schema)
