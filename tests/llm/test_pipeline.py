import importlib
import re

import pytest

from coordex.llm import jaccard_join, mixing, secrets_scan

pipeline = importlib.import_module("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    from coordex.llm.common import materialize

    for name, stage in pipeline.STAGES:
        after = materialize(stage(spark, docs, DATA), name)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns_stay(stages):
    for _, _, before, after in stages[:-1]:
        assert before == after


def test_language_keeps_documents_with_letters(stages):
    before, after, *_ = stages[0]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if any(c.isalpha() for c in r.text))


def test_one_of_each_class(stages):
    from tests.llm.test_jaccard_join import brute

    before, after, *_ = stages[1]
    classes = {i: c for i, c, _ in brute([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after)


def test_redaction(stages):
    before, after, *_ = stages[2]
    assert {r.doc_id: r.text for r in after} == {r.doc_id: secrets_scan.redact(r.text) for r in before}
    assert not any(secrets_scan.base_spans(r.text) for r in after)
    assert all(r.n_chars == len(r.text) for r in after)


def test_redaction_changes_secrets_alone(spark):
    """By the base patterns of the tests: all are gone, and what lies between the marks is the old text."""
    from tests.llm.test_secrets_packing import base

    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    before, after = docs.collect(), pipeline.STAGES[2][1](spark, docs, DATA).collect()
    old, some = {r.doc_id: r.text for r in before}, 0
    for r in after:
        text = old[r.doc_id]
        some += bool(base(text))
        assert not base(r.text)
        at = 0
        for part in re.split(r"\[(?:assign|access|hex|id|key|endpoint)\]", r.text):
            at = text.index(part, at) + len(part)
        assert base(text) or r.text == text or re.search(r"\[(?:id|key|endpoint)\]", r.text)
    assert some


def test_mix_repeats_rows(stages):
    """Against the SQL of the mix, over the rows that the stage got."""
    import duckdb
    import pandas as pd

    before, after, *_ = stages[3]
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.text, r.source) for r in before], columns=["doc_id", "text", "source"]))
    want = con.sql(f"select doc_id, copies from ({mixing.ORACLE}) where copies > 0").fetchall()
    assert copies == dict(want)


def test_a_run_leaves_its_last_table_alone(spark):
    from pathlib import Path

    from coordex.written import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "coordex" / spark.sparkContext.applicationId
    before = set(folder.iterdir()) if folder.exists() else set()
    out = pipeline.run(spark, DATA)
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}
    assert out.count() > 0 and not left & {"pipeline-language", "pipeline-near_duplicates", "pipeline-secrets", "join-profiles", "paths"} and "pipeline-mixing" in left


def test_pieces_tile_documents(stages):
    before, after, *_ = stages[4]
    per, seqs = {}, {}
    for r in after:
        per.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(per) == {r.doc_id for r in before}
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_extra_and_clashing_columns(spark):
    rows = [(i, f"the text number {i} of the and it is", "en", "s", 10, 1, "x") for i in range(12)] + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, target string")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() >= 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
    assert jaccard_join.join(docs).count() == 0
