import hashlib
import math
import random

import numpy as np
import pytest

from coordex.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<float>, label string, code int, v int, error string"


def brute(rows, entries=64, rounds=2):
    """Plain Python integers: (vec_id, code, error, label_error) and the digest."""
    able = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in able]
    n = min(set(sizes), key=lambda s: (-sizes.count(s), s), default=0)
    wide = max(1, -(-n // 16)) * 16
    able = [(i, v + [0] * (wide - n), label) for i, v, label in able if len(v) == n]
    w = wide // 16
    cut = lambda v: [v[p * w : p * w + w] for p in range(16)]
    able = sorted(((i, cut(v), label) for i, v, label in able), key=lambda r: (r[0] is None, r[0], r[1]))
    books = [[able[e][1][p] for e in range(min(entries, len(able)))] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda v: [min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(16)]
    for _ in range(rounds):
        met = [assign(v) for _, v, _ in able]
        new = [[list(c) for c in b] for b in books]
        for p in range(16):
            for e in range(len(books[p])):
                own = [v[p] for (_, v, _), a in zip(able, met) if a[p] == e]
                if own:
                    new[p][e] = [sum(x) // len(own) for x in zip(*own)]
        books = new
    out, by = [], {}
    for i, v, label in able:
        a = assign(v)
        out.append((i, "".join(f"{e:02x}" for e in a), sum(far(v[p], books[p][e]) for p, e in enumerate(a)), label))
        by[label] = by.get(label, 0) + out[-1][2]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((i, c, d, by[label]) for i, c, d, label in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def got(spark, rows, **kw):
    found = C.compress(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=str), {r.codebooks_sha256 for r in found}


def some(n, seed, wide=32, spread=0.3):
    rng = random.Random(seed)
    return [(i * 3, [rng.gauss(0, spread) for _ in range(wide)], None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else str(rng.randrange(5)), 0, 0, None) for i in range(n)]


@pytest.mark.parametrize(("n", "wide", "entries"), [(150, 32, 64), (150, 16, 5), (40, 48, 64), (90, 40, 7)])
def test_equal_to_plain_integers(spark, n, wide, entries):
    rows = some(n, n + wide, wide)
    want, digest = brute(rows, entries)
    assert got(spark, rows, entries=entries) == (want, {digest})


def test_edges(spark):
    rows = some(80, 9)
    rows += [(900, None, "a", 0, 0, None), (901, [math.nan] * 32, "a", 0, 0, None), (902, [math.inf] * 32, "a", 0, 0, None), (903, [None] * 32, "a", 0, 0, None), (904, [1.0] * 3, "a", 0, 0, "x" * 100_000), (905, [], "b", 0, 0, None)]
    rows += rows[:3] * 5 + [(0, rows[7][1], "a", 0, 0, None), (None, rows[9][1], "a", 0, 0, None)] * 2
    rows += [(k, [0.5] * 32, "hot", 0, 0, None) for k in range(1000, 1100)]  # ties: one vector many times
    want, digest = brute(rows)
    assert got(spark, rows) == (want, {digest})
    assert got(spark, []) == ([], set())
    assert got(spark, [(1, [], None, 0, 0, None)]) == ([(1, "00" * 16, 0, 0)], {hashlib.sha256(",".join(["0"] * 16).encode()).hexdigest()})


def test_intervals_hold_every_nearest_entry():
    """Also where float32 rounds: components up to 2^27, near ties, equal entries."""
    rng = np.random.default_rng(1)
    kept = total = 0
    for top, w in ((1 << 6, 4), (1 << 14, 4), (1 << 27, 4), (1 << 20, 64)):
        for _ in range(20):
            c = rng.integers(-top, top, (64, w))
            c[::7] = c[3]
            c[1] = c[3] + rng.integers(-1, 2, w)
            x = np.concatenate([rng.integers(-top, top, (50, w)), c[rng.integers(0, 64, 50)] + rng.integers(-1, 2, (50, w))])
            exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
            may = C.screen(x, c)
            entry, error = C.nearest(x, c)
            for k, d in enumerate(exact):
                assert all(may[k, e] for e in range(64) if d[e] == min(d))
                assert (int(entry[k]), int(error[k])) == (d.index(min(d)), min(d))
            kept, total = kept + int(may.sum()), total + may.size
    assert kept < 0.5 * total


def test_too_large(spark):
    with pytest.raises(ArithmeticError):
        C.nearest(np.full((1, 4), 1 << 40), np.zeros((2, 4), np.int64))
    with pytest.raises(Exception, match="64 bits"):
        got(spark, [(i, [1e30 * i] * 16, "a", 0, 0, None) for i in range(3)])
