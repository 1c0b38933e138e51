import hashlib
import random

import numpy as np

from coordex.llm import repeats as R

SCHEMA = "doc_id long, text string, batch_id long, place string"


def brute(rows, length=R.LENGTH):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans) // 2, hashlib.sha256(r.kept).hexdigest()) for r in R.remove_repeats(df).collect()], key=str)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = ["the", "and", "été", "of", "onle", "ärz", "re", "x"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(rng.randint(15, 80)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            text += p[a : a + rng.randint(60, 400)] + say(rng.randint(0, 15))
        rows.append((i * 3, text, None, "a"))
    rows += [(400 + i, rows[5][1], 1, None) for i in range(20)]
    rows += [(500, None, None, None), (501, "", 1, "b"), (502, "ab" * 4000, 1, "c"), (503, "x" * 99, 1, ""), (504, "x" * 300, 1, "")]
    monkeypatch.setattr(R, "BATCH", 4000)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, None, None)], SCHEMA)) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_intervals_nest():
    lcp = np.array([0, 100, 120, 100, 0, 3, 150, 150, 0])
    assert sorted(R.intervals(lcp)) == [(0, 3, 100, True), (1, 2, 120, False), (5, 7, 150, True)]
    assert list(R.intervals(np.array([0, 2, 5]))) == []


def test_maximal_repeats_list_every_occurrence(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, f"{chr(65 + i)}" * 5 + passage + f"{chr(75 + i)}" * 5, None, None) for i in range(4)]
    found = R.maximal_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    covered = {(o.doc_id, p) for r in found for o in r.occurrences for p in range(o.start, o.start + r.length)}
    assert {(i, p) for i in range(4) for p in range(5, 135)} <= covered
    text = {r[0]: r[1] for r in rows}
    for r in found:
        assert r.length >= 100 and len({text[o.doc_id][o.start : o.start + r.length] for o in r.occurrences}) == 1 and len(r.occurrences) == 4


def groups(df):
    return {(r.length, tuple((o.doc_id, o.start) for o in r.occurrences)) for r in R.maximal_repeats(df).collect()}


def test_a_long_passage_is_one_group(spark, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    rows = [(i, f"{chr(65 + i)}" * 30 + passage + f"{chr(75 + i)}" * 30, None, None) for i in range(5)]
    want = {(1000, tuple((i, 30) for i in range(5)))}
    for batch in (R.BATCH, 1100):  # all documents together, and each in a batch of its own
        monkeypatch.setattr(R, "BATCH", batch)
        assert groups(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == want
    # A part of it in two more documents, later ones: both strings, each with all its places.
    rows += [(i, f"{chr(65 + i)}" * 30 + passage[200:500] + f"{chr(75 + i)}" * 30, None, None) for i in (8, 9)]
    assert groups(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want | {(300, tuple((i, 230 if i < 8 else 30) for i in (0, 1, 2, 3, 4, 8, 9)))}


def test_groups_are_diverse_to_the_left_and_right(spark):
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (260, 400))
    rows = [(1, "1" + a + "5", None, None), (2, "2" + a + "6" + b, None, None), (3, "3" + b + "7", None, None), (4, "4" + b + "8", None, None)]
    assert groups(spark.createDataFrame(rows, SCHEMA)) == {(260, ((1, 1), (2, 1))), (400, ((2, 262), (3, 1), (4, 1)))}


def test_a_part_with_an_earlier_leader(spark, monkeypatch):
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(1000)
    rows = [(0, say(36) + "#" + passage[300:600] + "#" + say(50), None, None), (1, "1" + passage + "1", None, None), (2, say(20) + "2" + passage + "2", None, None)]
    want = {(1000, ((1, 1), (2, 21))), (300, ((0, 37), (1, 301), (2, 321)))}
    for batch in (R.BATCH, 1100):
        monkeypatch.setattr(R, "BATCH", batch)
        assert groups(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == want


def brute_groups(rows, length=R.LENGTH):
    """All substrings that occur more than once and differ to both sides."""
    places = {}
    texts = [(doc_id, (text or "").encode()) for doc_id, text, *_ in rows]
    for d, (_, b) in enumerate(texts):
        for i in range(len(b)):
            for j in range(i + length, len(b) + 1):
                places.setdefault(b[i:j], []).append((d, i))
    out = set()
    for w, at in places.items():
        before = {texts[d][1][i - 1] if i else (d, "begin") for d, i in at}
        after = {texts[d][1][i + len(w)] if i + len(w) < len(texts[d][1]) else (d, "end") for d, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out.add((len(w), tuple(sorted(((texts[d][0], i) for d, i in at), key=lambda x: (x[0] is not None, x)))))
    return out


def test_groups_match_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [say(rng.randint(90, 170)) for _ in range(4)]
    passages += [passages[0][:60] + passages[1][20:], "ab" * 70, "z" * 125]
    rows = []
    for i in range(24):
        text = say(rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(passages), rng.choice([0, 0, 5, 17])
            text += p[a : a + rng.choice([105, 120, 400])] + say(rng.choice([0, 0, 3]))
        rows.append((i * 2, text, None, None))
    rows += [(100, rows[3][1], None, None), (None, rows[4][1], None, None), (101, None, None, None), (102, "", None, None), (103, "q" * 100, None, None)]
    monkeypatch.setattr(R, "BATCH", 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found, want = groups(df), brute_groups(rows)
    assert len(want) > 50 and found == want
    # What is removed is what all places of the groups but the first ones cover.
    text, cover = {r[0]: (r[1] or "").encode() for r in rows}, {}
    for n, at in found:
        for doc_id, start in at[1:]:
            cover.setdefault(doc_id, set()).update(range(start, start + n))
    assert {r.doc_id: r.n_removed for r in R.remove_repeats(df).collect()} == {d: len(cover.get(d, ())) for d in text}


def test_groups_of_repeated_rows_and_of_nothing(spark):
    rng = random.Random(13)
    text = "".join(rng.choice("abcdefgh ") for _ in range(150))
    assert groups(spark.createDataFrame([(1, text, None, None)] * 3, SCHEMA)) == {(150, ((1, 0),) * 3)}
    assert groups(spark.createDataFrame([], SCHEMA)) == set()
    assert groups(spark.createDataFrame([(1, text, None, None), (2, None, None, None)], SCHEMA)) == set()


def test_hot_passages_are_split(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) + passage[: rng.randint(500, 700)] + str(i) * 9, None, None) for i in range(60)]
    for name, value in (("BATCH", 1500), ("HOT", 3), ("SALTS", 4)):
        monkeypatch.setattr(R, name, value)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_tree_of_leaders():
    # Suffixes 0..4 in sorted order with ranks 3, 0, 4, 1, 2: one interval of 100 bytes, one of 120 inside.
    lcp, rank, left = np.array([0, 100, 120, 120, 100]), np.array([3, 0, 4, 1, 2]), np.array([-1, 5, 5, 6, 7])
    found = sorted(zip(*R.leaders(lcp, rank, left)))
    assert found == [(1, 120, 0), (2, 100, 0), (3, 100, 0), (4, 120, 0)]
    assert R.leaders(np.array([0, 110]), np.array([0, 1]), np.array([7, 7])) == ([], [], [])


def test_periodic_and_long_texts(spark):
    rows = [(1, "x" * 20_000, None, None), (2, "ab" * 15_000 + "x" * 500, None, None), (3, "ab" * 200, None, None), (None, "y" * 400, None, None), (None, "y" * 400, None, None)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
