import zlib

import numpy as np
import pytest

from coordex.llm import language_id as L

DATA = "/root/testdata/sf0.01/documents.parquet"
SCHEMA = "doc_id long, text string, lang string, score double, second string"


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 20):
        code = L.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        assert not (np.abs(code.sum(0)) == n).any()
    assert min((a != b).sum() for i, a in enumerate(L.codewords(20)) for b in L.codewords(20)[:i]) >= 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    text = ["the and of is in with", "der die das und ist ein"]
    rows = [(i, text[i % 2] * 3, ("en", "de")[i % 2], 1.0, "x") for i in range(40)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, " 12 ²½ -- ", None, None, None), (None, text[0], None, None, None), (103, text[1] * 30_000, None, None, None), (103, text[1], None, None, None)]
    got = {}
    for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[100] == got[101] == got[102] == [("und", 0.0)]
    assert got[None][0][0] == "en" and {x[0] for x in got[103]} == {"de"}
    kept = L.drop_unidentified(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "score", "second"] and kept.count() == 43 and kept.where("lang is null").count() == 0


def test_nothing_learned_one_language_and_empty(spark):
    nothing = L.identify(spark.createDataFrame([(1, "abc def", None, None, None)], SCHEMA)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    one = L.identify(spark.createDataFrame([(i, "abc def", "en", None, None) for i in range(9)], SCHEMA)).collect()
    assert {r.lang_pred for r in one} == {"en"}
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ambiguity_is_flagged():
    rows = [("the and of is in with " * 5, "en"), ("der die das und ist ein " * 5, "de"), ("le la les et est un " * 5, "fr")]
    m = L.train(rows)
    assert m.predict(["the and of is in with"])[0][0] == "en"
    assert m.predict(["zq"])[0][2]
    for texts in (["x", None], []):
        assert len(m.predict(texts)) == len(texts)


@pytest.mark.parametrize("n", [1, 50])
def test_batches_do_not_matter(n):
    rows = [("the and of is in with " * 5, "en"), ("der die das und ist ein " * 5, "de")]
    m, texts = L.train(rows), ["the of", "und das", "été"] * n
    assert [m.predict([t])[0][0] for t in texts] == [p[0] for p in m.predict(texts)]


def test_decoder_equals_a_plain_one():
    """Words of one margin a bit, losses by their definition, one text at a time."""
    import math

    rows = [("the and of is in with " * 5, "en"), ("der die das und ist ein " * 5, "de"), ("le la les et est un " * 5, "fr"), ("el la los y es un " * 5, "es")]
    m = L.train(rows)
    texts = ["the und les", "y es", "a" * 300, "één twee", "12 und 12", "X"]
    for text, got in zip(texts, m.predict(texts)):
        data = [c if c >= 128 or chr(c).isalpha() else 32 for c in b"   " + text.lower().encode()] + [32] * 4
        margins = []
        for w in m.weights:
            total = 0.0
            for i in range(len(data) - 4):
                for n in L.GRAMS:
                    code = sum(data[i + k] << 8 * k for k in range(n))
                    total += float(w[(code * int(L.MIX) & 0xFFFFFFFF) >> 16])
            margins.append(total / (len(L.GRAMS) * math.sqrt(len(data) - 4)))
        losses = [sum(math.log1p(math.exp(-x * y)) for x, y in zip(margins, word)) for word in m.code]
        order = sorted(range(len(losses)), key=lambda k: (losses[k], k))
        share = 1 / sum(math.exp(losses[order[0]] - x) for x in losses)
        assert got[0] == m.languages[order[0]] and got[3] == m.languages[order[1]] and abs(got[1] - share) < 1e-6


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_BYTES", 400)
    seen = {}
    monkeypatch.setattr(L, "train", lambda rows: seen.update(rows=rows))
    docs = [(i, f"word{i} and more " * 5, "en" if i % 3 else "de", None, None) for i in range(300)] + [(900, "x " * 5000, "fr", None, None)]
    L.learn(spark.createDataFrame(docs, SCHEMA), per_language=20)
    by = {lang: sum(len(t) for t, x in seen["rows"] if x == lang) for lang in ("en", "de", "fr")}
    assert 200 < by["en"] <= 400 and 200 < by["de"] <= 400 and by["fr"] == 0


def test_nothing_learned_keeps_texts(spark):
    rows = [(1, "abc", None, None, None), (2, "12", None, None, None), (3, None, None, None, None)]
    assert [r.doc_id for r in L.drop_unidentified(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]


def test_all_bytes_bound_the_sample(spark):
    rows = [(i, f"word{i % 7} " * 50, f"l{i % 40}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from coordex.llm import language_id as L

    seen = []
    old = L.train
    L.train = lambda chosen: seen.append(chosen) or old(chosen)
    try:
        L.learn(df, all_bytes=20_000)
    finally:
        L.train = old
    assert 0 < sum(len(t) for t, _ in seen[0]) <= 20_000 and len({lang for _, lang in seen[0]}) == 40
