"""Language identification with error-correcting output codes.

Each language has a codeword of signs. For every bit a binary n-gram classifier
(log odds of hashed byte 3- and 4-grams between the languages on either side)
gives a margin; loss-weighted decoding adds up the logistic losses of a codeword
under all margins and takes the codeword that loses least. A second codeword
that loses hardly more marks the row as ambiguous.

Learning: from at most ``SAMPLE`` whole texts and ``SAMPLE_BYTES`` a language
(``SAMPLE_ALL`` texts and ``ALL_BYTES`` over all), the least by hash, of labelled documents that are
not held out (crc32 of doc_id as text, modulo 5, is not 0); a text that alone is
larger than ``SAMPLE_BYTES`` is not learned from. Predictions see the text alone.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if nothing was learned; with one learned language every other text is that
language; repeated rows get equal predictions; codewords that lose alike count in
order of their languages; a very long text is read whole, in a batch of its own; an
empty table gives an empty table; extra columns are ignored.

Scale: documents are counted by language, and only those whose hash lies under a
bound that leaves about twice the sample are ranked, so a language of a third of all
rows is not one task; the model (codewords and BITS columns of 2^16 weights) is bounded and
goes with the task; the rest is one map over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, rebatched, table

SAMPLE, SAMPLE_ALL, SAMPLE_BYTES, ALL_BYTES = 1000, 20_000, 4 << 20, 128 << 20
DIMS, GRAMS = 1 << 16, (3, 4)
AMBIGUOUS = 0.6
LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter counts as a blank.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
MIX = np.uint32(2654435761)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams at each byte of the joined texts, and the texts' starts and lengths."""
    parts = [b"   " + t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(p) for p in parts])
    data = FOLD[np.frombuffer(b"".join(parts) + b"    ", np.uint8)].astype(np.uint32)
    n = len(data) - 4
    hashed, code = [], data[:n].copy()
    for k in range(1, max(GRAMS)):
        code |= data[k : k + n] << np.uint32(8 * k)
        if k + 1 in GRAMS:
            hashed.append(((code * MIX) >> np.uint32(16)).astype(np.int64))
    return hashed, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths


def codewords(classes: int) -> np.ndarray:
    """Signs, a row a language. Exhaustive up to 5 languages; beyond, seeded
    random columns, of several tries the one whose rows differ most."""
    if classes < 2:
        return np.ones((classes, 0))
    if classes <= 5:
        cols = [[1 - 2 * (k >> i & 1) for i in range(classes)] for k in range(1, 1 << (classes - 1))]
        return np.array(cols, float).T
    bits, rng, best, apart = max(15, 4 * int(np.ceil(np.log2(classes)))), np.random.default_rng(11), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        if (np.abs(code.sum(0)) == classes).any():
            continue
        near = (bits - (code @ code.T)[~np.eye(classes, dtype=bool)].max()) / 2
        if near > apart:
            best, apart = code, near
    return best


class Model:
    """languages, codewords and, for each bit, a weight for each hashed n-gram."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.weights = np.stack(
            [np.log(share[c > 0].mean(0) / share[c < 0].mean(0)).astype(np.float32) for c in self.code.T], 0
        ) if len(languages) > 1 else np.zeros((0, counts.shape[1] if len(counts) else DIMS), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, str | None]]:
        """language, score, ambiguous and the second language of each text."""
        out: list = [("und", 0.0, False, None)] * len(texts)
        able = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if not able or not self.languages:
            return out
        if len(self.languages) == 1:
            for i in able:
                out[i] = (self.languages[0], 1.0, False, None)
            return out
        hashed, starts, lengths = grams([texts[i] for i in able])
        margins = np.stack([sum(np.add.reduceat(w[h], starts, dtype=np.float64) for h in hashed) for w in self.weights], 1)
        margins /= (len(hashed) * np.sqrt(lengths))[:, None]  # grows with the text's length, less than in proportion
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        p = np.exp(losses.min(1, keepdims=True) - losses)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(losses, 1, kind="stable")
        for k, i in enumerate(able):
            a, b = order[k, 0], order[k, 1]
            out[i] = (self.languages[a], float(p[k, a]), bool(p[k, a] < AMBIGUOUS), self.languages[b])
        return out


def train(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) pairs."""
    languages = sorted({lang for _, lang in rows})
    counts = np.zeros((len(languages), DIMS))
    for k, lang in enumerate(languages):
        texts = [t for t, x in rows if x == lang]
        for i in range(0, len(texts), 100):
            for h in grams(texts[i : i + 100])[0]:
                counts[k] += np.bincount(h, minlength=DIMS)
        counts[k, (0x20202020 * int(MIX) & 0xFFFFFFFF) >> 16] = 0  # padding
    return Model(languages, counts)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, per_language: int = SAMPLE, over_all: int = SAMPLE_ALL, all_bytes: int = ALL_BYTES) -> Model:
    """The model from a bounded sample; only (doc_id, lang, size) are ranked, then the
    chosen texts are fetched."""
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    able = able.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Written, so that the rows need not move by language where it is small.
    counts = materialize(able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    hashed = able.select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.xxhash64(F.lit(3), "doc_id", "text").alias("h")).where(F.col("bytes") <= SAMPLE_BYTES)
    # The share of the range of hashes that leaves twice the sample, and room for chance.
    bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * (2 * per_language + 50) / F.col("n")
    few = hashed.join(counts, "lang").where(F.col("h") < bound)
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = few.withColumn("r", F.row_number().over(order)).withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ids = few.where((F.col("r") <= per_language) & (F.col("upto") <= SAMPLE_BYTES)).orderBy("r", "lang").limit(over_all)
    # At most over_all rows, by construction; of equal rows one. Languages take turns, so
    # the bound on all bytes cuts each language's last ones.
    ids = ids.withColumn("all", F.sum("bytes").over(Window.orderBy("r", "lang").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("all") <= all_bytes)
    ids = materialize(ids.select("doc_id", "lang", "h").distinct(), "language-sample")
    texts = able.withColumn("h", F.xxhash64(F.lit(3), "doc_id", "text")).join(F.broadcast(ids), ["doc_id", "lang", "h"], "left_semi")
    chosen = [(r.text, r.lang) for r in texts.distinct().orderBy("doc_id", "lang", "text").collect()]
    return train([(t, lang) for t, lang in chosen if LETTER.search(t)])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, second per document."""
    model = model or learn(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches, "text", 1 << 20):
            found = list(zip(*model.predict(b.column(2).to_pylist())))
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(found, (pa.string(), pa.float64(), pa.bool_(), pa.string()))]], ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "second"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, second string")


def op1_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def drop_unidentified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with a language (all columns); lang is filled in where it is null.
    Only ``und`` goes: ambiguity and score have no effect, and a lang that is there
    stays even against the prediction. If nothing was learned (no document has a lang),
    documents with a letter stay as they are, with a null lang."""
    model = model or learn(docs)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rebatched(batches, "text", 1 << 20):
            texts = b.column(at).to_pylist()
            found = [p[0] for p in model.predict(texts)] if model.languages else [None if t and LETTER.search(t) else "und" for t in texts]
            filled = pa.array([f if x is None else x for f, x in zip(found, b.column(lang).to_pylist())], b.schema.field(lang).type)
            b = pa.record_batch([filled if i == lang else c for i, c in enumerate(b.columns)], schema=b.schema)
            yield b.filter(pa.array([f != "und" for f in found]))

    return docs.mapInArrow(keep, docs.schema)
