import hashlib

from coordex.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, lang string, digest string"


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, r in enumerate(rows):
        t, n = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        c = fp.canonical(t)
        out.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), fp.digest(c), fp.digest(fp.canonical(e)), float(c == fp.canonical(e)), float(c == fp.canonical(n))))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r)[:7] for r in df.collect()], key=str)


def test_matches_brute_force(spark):
    rows = [(i, ("Straße  Ünï " * (i % 7)) + ("x" if i % 3 else ""), "de", "z") for i in range(0, 90, 2)]
    rows += [(91, None, None, None), (93, "", "en", "a"), (95, "é" * 40_000, "fr", "b"), (97, "STRASSE x", "de", "c"), (99, "strasse\n X", "de", "c")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(fp.fingerprint(df)) == brute(rows)


def test_empty_one_and_null_ids(spark):
    assert fp.fingerprint(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(7, "some text here", None, None)]
    assert got(fp.fingerprint(spark.createDataFrame(one, SCHEMA))) == brute(one)
    twice = fp.fingerprint(spark.createDataFrame([(None, "a b c d", None, None), (3, "a b c d", None, None)] * 2, SCHEMA)).collect()
    assert len(twice) == 4 and len({r.fingerprint for r in twice}) == 1


def test_clash_of_digests_is_told_apart(spark):
    same = lambda c: "same"
    rows = [(1, "One text", None, None), (2, "two texts", None, None), (3, "one  TEXT", None, None), (4, "three", None, None)]
    got = {r.doc_id: r for r in fp.fingerprint(spark.createDataFrame(rows, SCHEMA), same).collect()}
    assert got[1].fingerprint == got[3].fingerprint and len({r.fingerprint for r in got.values()}) == 3
    assert all(r.near_edited == 0 for r in got.values())


def test_names_of_clashing_texts_agree(spark):
    """With one digest for all: equal canonical forms, and only those, have one
    fingerprint, edited texts included."""
    same = lambda c: "same"
    rows = [(1, "abcd efgh", None, None), (2, "two", None, None), (3, "one  TEXT", None, None), (4, "xxxx", None, None), (5, "x" * 40, None, None), (6, "x" * 40, None, None), (7, "ABCD eTWO", None, None), (None, "", None, None)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    form = {}
    for k, r in enumerate(order):
        form[r[0]] = fp.canonical(r[1]), fp.canonical(fp.edit(r[1], order[(k + 1) % len(order)][1]))
    out = fp.fingerprint(spark.createDataFrame(rows, SCHEMA).repartition(3), same).collect()
    named = [(form[r.doc_id][0], r.fingerprint) for r in out] + [(form[r.doc_id][1], r.edited_fingerprint) for r in out]
    assert len({n for _, n in named}) == len({f for f, _ in named}) == len(set(named))
    assert any(r.near_edited == 1 for r in out) and all((r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) for r in out)


def test_many_rows_without_ids(spark):
    rows = [(None, f"text {i % 40}", None, None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(str, fp.fingerprint(df.repartition(n)).collect())) for n in (3, 7))
    assert a == b and len(a) == 400
