"""The corpus pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coordex.llm import jaccard_join, language_id, mixing, packing, secrets_scan
from coordex.llm.common import materialize, table
from coordex.written import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language (null, empty or letterless text) go;
    a null lang is filled in, one that is there stays. Without any lang to learn from,
    documents with a letter stay as they are. Repeated rows fare alike; long texts are
    read whole; an empty table gives an empty table."""
    return language_id.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least doc_id,
    of a class without any the one whose words come first by hash. Texts without words
    are classes of their own, repeated rows of them one document; a null doc_id is one
    like others; long texts are compared whole."""
    return jaccard_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind, and n_chars follows. All rows
    stay; null and empty texts stay as they are; of overlapping secrets the first names
    the replacement; long texts are scanned whole, in linear time."""
    return secrets_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights; a document comes as often as it is taken, up
    to three times. Texts without words are never taken; a null source is one like
    others, last in order; ties go by source and shuffle; rows with one doc_id, text and
    source are the first of them, as often as all are taken."""
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, dealt to sequences. A null or empty text is its closing
    id alone; long texts are cut into pieces that tile them; repeated rows are packed
    each; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, tokenizers and sketches are beyond SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. What a stage wrote on its way, and the
    table before it, go as soon as its own table stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            own = written.pop()
            written += [before] if before else []
            before = own
    return STAGES[-1][1](spark, docs, sf_dir)
