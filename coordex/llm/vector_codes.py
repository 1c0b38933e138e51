"""Vector code compression: product codes of whole-number vectors, with exact nearest entries.

A vector's components become floor(256 * x), x as double, and are cut into ``PARTS``
equal consecutive parts; each part position has a codebook of up to ``ENTRIES``
entries, which starts as that part of the rows with the smallest vec_ids. In each of
``ROUNDS`` rounds every part goes to its nearest entry (squared Euclidean distance,
ties to the lower index) and each entry becomes floor(sum / count) of its parts,
component by component; an entry without parts stays. Then parts are assigned again.

Nearest entries are screened by a product of matrices in float32. With u = 2^-24 and
parts of w components, entry c of part x scores |c|^2 - 2 x.c; converting, multiplying,
adding up in any order and subtracting err by at most (w + 6) u 1.02 (2 |x| |c| + |c|^2),
while (w + 6) u is below 0.01. The score plus and minus that is an interval that holds the true value. Entries
whose interval reaches below the lowest upper end may be nearest; where there are several,
all of them are evaluated in int64, and the lowest index of the least is taken.

Defined results: rows whose vector is null or holds null or non-finite components take
no part, nor do vectors of another length than the most frequent (ties: the smaller);
a length that ``PARTS`` does not divide is filled up with zeros, an empty vector with one
component a part; null vec_ids take part and come last in the order of ids, rows with one
vec_id by their vectors; repeated rows are rows of their own; fewer rows than ``ENTRIES``
give as many entries; an empty table gives an empty table; extra columns, texts among
them, are not read. Distances that 64 bits can't hold are an ArithmeticError.

Scale: codebooks (ENTRIES x dimension whole numbers) go to the tasks; from each task come
counts and sums per part, entry and position, which Spark adds up. No row moves but to
meet its label's sum, where a label is dealt over salts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, null_last_key, salted_join, table
from .hard_negatives import _padded, finite, quantised

PARTS, ENTRIES, ROUNDS = 16, 64, 2
U = 2.0**-24
PAIRS = 1 << 20


def screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of x which rows of c may be the nearest: never lacks a nearest one."""
    wide = x.shape[1]
    if (wide + 6) * U >= 0.01:
        return np.ones((len(x), len(c)), bool)
    score = np.float32(-2) * (x.astype(np.float32) @ c.astype(np.float32).T)
    square = (c.astype(float) ** 2).sum(1)
    score = (score + square.astype(np.float32)[None]).astype(float)
    far = 2 * np.sqrt((x.astype(float) ** 2).sum(1))[:, None] * np.sqrt(square)[None] + square[None]
    slack = 1.02 * (wide + 6) * U * far
    return score - slack <= (score + slack).min(1)[:, None]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, in int64, a slice at a time."""
    out, step = np.empty(len(x), np.int64), max(1, PAIRS // max(1, x.shape[1]))
    for s in range(0, len(x), step):
        d = x[s : s + step] - c[s : s + step]
        out[s : s + step] = (d * d).sum(1)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of c (the lowest of ties) and the squared distance, exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] >= 1 << 62 or top < 0:
        raise ArithmeticError("a squared distance needs more than 64 bits")
    entry, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step = max(1, PAIRS // len(c))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        row, name = np.nonzero(screen(part, c))
        d = distances(part[row], c[name])
        start = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(d, start)
        hit = np.flatnonzero(d == least[row])
        entry[s : s + step] = name[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]
        error[s : s + step] = least
    return entry, error


def _parts(b: pa.RecordBatch, wide: int) -> np.ndarray:
    """rows x PARTS x width."""
    lists = b.column(b.schema.get_field_index("v"))
    return _padded(lists, wide).reshape(len(lists), -1, 1) if not wide else _padded(lists, wide).reshape(len(lists), PARTS, wide // PARTS)


def _summed(codebooks: np.ndarray, wide: int):
    """Counts and sums of the parts of each entry, once a task."""
    parts, entries, w = codebooks.shape

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, w), np.int64)
        for b in batches:
            x = _parts(b, wide)
            for p in range(parts):
                entry, _ = nearest(x[:, p], codebooks[p])
                count[p] += np.bincount(entry, minlength=entries)
                np.add.at(total[p], entry, x[:, p])
        p, e = np.nonzero(count)
        for s in range(0, len(p), 1024):
            i, j = p[s : s + 1024], e[s : s + 1024]
            at = np.tile(np.arange(w), len(i))
            i, j = np.repeat(i, w), np.repeat(j, w)
            cols = [i.astype(np.int32), j.astype(np.int32), at.astype(np.int32), count[i, j], total[i, j, at]]
            yield pa.record_batch([pa.array(c) for c in cols], ["part", "entry", "position", "n", "total"])

    return fn


def _coded(codebooks: np.ndarray, wide: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, error, codes = _parts(b, wide), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, PARTS), np.uint8)
            for p in range(PARTS):
                entry, d = nearest(x[:, p], codebooks[p])
                codes[:, p] = entry
                error += d
            code = pa.array([r.tobytes().hex() for r in codes], pa.string())
            yield pa.record_batch([b.column(0), b.column(1), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return fn


def kept(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label (text that is never null), v of the rows that take part, and v's length with its filling."""
    able = embeddings.where(finite(F.col("embedding")))
    able = able.select(F.col("vec_id").cast("long").alias("vec_id"), null_last_key(F.col("label")).alias("label"), quantised(F.col("embedding")).alias("v"))
    able = materialize(able, "codes-rows")
    common = able.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    n = common[0]["n"] if common else PARTS
    return able.where(F.size("v") == n), max(1, -(-n // PARTS)) * PARTS


def train(rows: DataFrame, wide: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks: parts x entries x width, whole numbers."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # ``entries`` rows
    start = np.zeros((len(first), wide), np.int64)
    for k, r in enumerate(first):
        start[k, : len(r["v"])] = r["v"]
    codebooks = np.ascontiguousarray(start.reshape(len(first), PARTS, wide // PARTS).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        sums = rows.select("v").mapInArrow(_summed(codebooks, wide), "part int, entry int, position int, n long, total long")
        sums = sums.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        codebooks = codebooks.copy()
        for r in sums.collect():  # at most entries x dimension rows
            codebooks[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256. Up to 256 entries, two hex digits each."""
    if not 1 <= entries <= 256:
        raise ValueError(f"entries {entries}")
    rows, wide = kept(embeddings)
    codebooks = train(rows, wide, entries, rounds)
    coded = materialize(rows.mapInArrow(_coded(codebooks, wide), "vec_id long, label string, code string, error long"), "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    out = salted_join(coded, sums, ["label"], F.col("code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same for vectors of 64 components, with the distances of all entries."""
    at = [f"x[{k}]" for k in range(1, 5)]

    def assigned(n: int) -> str:
        far = " + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, 5))
        return f"a{n} AS (SELECT vec_id, part, any_value(x) AS x, min({{'d': {far}, 'e': e}}) AS best FROM p JOIN c{n} USING (part) GROUP BY vec_id, part)"

    def moved(n: int) -> str:
        means = ", ".join(f"CAST(floor(sum({a})::DOUBLE / count(*)) AS BIGINT)" for a in at)
        return f"m{n} AS (SELECT part, best.e AS e, [{means}] AS c FROM a{n} GROUP BY ALL), c{n + 1} AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM c{n} b LEFT JOIN m{n} m USING (part, e))"

    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS nth
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, nth, part, v[4 * part + 1:4 * part + 4] AS x FROM k, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, nth AS e, x AS c FROM p WHERE nth < 64), {assigned(0)}, {moved(0)}, {assigned(1)}, {moved(1)}, {assigned(2)},
f AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
l AS (SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM f JOIN k USING (vec_id))
SELECT l.*, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256 FROM l
"""


ORACLE = _oracle()
