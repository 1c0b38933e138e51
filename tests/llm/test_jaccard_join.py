import random
import re

import numpy as np

from coordex.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, root long, node long"


def brute(rows):
    """(doc_id, class_id, n_links) from all pairs."""
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted([(r[0], least.get(top(i)), links[i]) for i, r in enumerate(rows)], key=str)


def got(df):
    return sorted([(r.doc_id, r.class_id, r.n_links) for r in J.join(df).collect()], key=str)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    rows, passage = [], say(60)
    for i in range(n):
        w = say(rng.randint(1, 150))
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            rows.append((len(rows), "  ".join(v)))
        if i % 4 == 0:
            rows.append((len(rows), " ".join(passage + say(30))))
    return [(a, b, None, 7) for a, b in rows]


def test_matches_brute_force(spark):
    rows = rows_of(80) + [(9000, None, 1, 1), (9001, "", None, 1), (9002, " \n", 1, 1), (None, "a b c d e f", 1, 1), (9003, "a b c d e f", 1, 1), (9004, "one two", 1, 1), (9005, "one two", 1, 1), (9005, "one two", 1, 1)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_large_groups_are_split_and_counted(spark):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(300):
        v = list(base)
        v[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(v), None, None))
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_document_of_each_class(spark):
    rng = random.Random(8)
    say = lambda k: [f"v{rng.randrange(500)}" for _ in range(k)]
    near = lambda w: [*w[:-1], "other"]
    a, b, c, d = say(80), say(80), say(80), say(80)
    kept = [(3, a), (5, b), (None, c), (8, d)]
    gone = [(None, near(a)), (5, near(a)), (None, near(c)), (None, near(c)), (9, near(d)), (8, near(d)), (None, d)]
    # Of classes without ids, and of a doc_id with two near texts, either may stay.
    either = {"c": {" ".join(c), " ".join(near(c))}, "d": {" ".join(d), " ".join(near(d))}}
    rows = [(i, " ".join(w), None, 1) for i, w in kept + gone] + [(5, "  ".join(b), None, 1), (None, "", None, 1), (None, "", None, 2), (None, None, None, 1), (11, " ", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = [(r.doc_id, r.text) for r in J.keep_one(df).collect()]
    assert J.keep_one(df).columns == df.columns
    blank = [r for r in out if not (r[1] or "").strip()]
    assert sorted(blank, key=str) == sorted([(None, ""), (None, None), (11, " ")], key=str)
    left = [r for r in out if r not in blank]
    assert len(left) == 4
    assert (3, " ".join(a)) in left and [i for i, t in left if t.split() == b] == [5]
    assert [i for i, t in left if t in either["c"]] == [None] and [i for i, t in left if t in either["d"]] == [8]


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_overlaps_and_forest():
    a = [np.array([1, 2, 3], np.uint64), np.array([2, 9], np.uint64)]
    assert J._overlaps(a, a).tolist() == [[3, 1], [1, 2]]
    like = np.zeros((4, 4), bool)
    like[3, 2] = like[2, 3] = like[0, 3] = like[3, 0] = True
    assert J._forest(like, np.arange(4), np.arange(4))[0].tolist() == [0, 1, 0, 0]


def test_rows_without_ids(spark):
    """Near copies without doc_id are as many links as with one, and no more work."""
    rng = random.Random(11)
    base = [f"v{i}" for i in range(120)]
    rows = [(None, " ".join([*base[:k], f"x{i}", *base[k + 1 :]]), None, None) for i in range(400) for k in [rng.randrange(120)]]
    out = got(spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(4))
    assert out == brute(rows + rows[:50])


def test_very_long_text_and_small_blocks(spark, monkeypatch):
    rng = random.Random(13)
    long = [f"w{rng.randrange(9000)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-500], "other"])), (3, "x " * 100_000), (4, "y" * 500_000)]
    rows = [(a, b, None, None) for a, b in rows] + [(10 + r[0], *r[1:]) for r in rows_of(15)]
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 300)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_helper_names_are_free(spark):
    schema = "doc_id long, text string, _id long, _x string, _words string, _nth int, _leads int, _null int"
    rows = [(i, t, 1, "a", "b", 2, 3, 4) for i, t in enumerate(["a b c d e f", "a b c d e f", "one two", ""])]
    out = J.keep_one(spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2], rows[3]]


def test_recall_on_the_documents(spark):
    """All links of the sf0.1 documents, from an exact join over rare shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    sets, times = [], {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        s = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
        sets.append(s)
        for x in s:
            times[x] = times.get(x, 0) + 1
    posted, links = {}, [0] * len(docs)
    for i, s in enumerate(sets):
        rare = sorted(s, key=lambda x: (times[x], x))[: len(s) - -(-8 * len(s) // 10) + 1]
        for j in {j for x in rare for j in posted.get(x, ())}:
            if 10 * len(s & sets[j]) >= 8 * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
        for x in rare:
            posted.setdefault(x, []).append(i)
    found = {r.doc_id: r.n_links for r in J.op9_jaccard_join(spark, "/root/testdata/sf0.1").collect()}
    want = {r.doc_id: n for r, n in zip(docs, links)}
    assert sum(links) > 1000 and sum(min(found[k], n) for k, n in want.items()) >= 0.999 * sum(links)
    assert all(found[k] <= n for k, n in want.items())


def test_components_of_chains_stars_and_none(spark):
    import random

    from coordex.llm.components import components

    rng = random.Random(3)
    names = rng.sample(range(10_000), 400)
    edges = [(names[i], names[i + 1]) for i in range(150)]  # one chain
    edges += [(names[200], names[i]) for i in range(201, 300)]  # one hub
    edges += [(names[i], names[i + 1]) for i in range(300, 398, 2)] * 2  # pairs, each twice
    edges += [(names[399], names[399])]  # a loop joins nothing
    top = {a: a for e in edges for a in e}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    want = {a: find(a) for a in top if a != names[399]}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
