import zlib
from collections import Counter

from coordex.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, key string, target int"


def docs(spark, n=500, parts=5):
    rows = [(i, "w" * (i % 9 + 1) + " x" * (i % 13), None if i % 17 == 0 else f"s{i % 4 if i % 3 else 0}", "a", None, 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_shards_match_the_mixture(spark):
    rows, df = docs(spark)
    out = sharding.interleave(df).collect()
    assert len(out) == 500
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    total = Counter(r[2] for r in rows)
    for s in range(40):
        mine = Counter(r.source for r in out if r.shard == s)
        assert all(abs(mine[k] - n * counts[s] / 500) <= 2 for k, n in total.items())
    by_id = {r[0]: r for r in rows}
    for r in out:
        text = by_id[r.doc_id][1].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    again = sharding.interleave(df.repartition(9)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in out}


def test_sharding_odd_rows(spark):
    rows = [(None, None, None, None, None, None)] * 3 + [(1, "é", "s", None, None, None)] * 45 + [(2, "x" * 100_000, "s", None, None, None)]
    out = sharding.interleave(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [1] * 31 + [2] * 9
    assert {r["size"] for r in out} == {16, 18, 100_016}
    assert sharding.interleave(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(sharding.interleave(spark.createDataFrame(rows[:2], SCHEMA)).collect()) == 2


def fair(sizes, epochs=3):
    """Targets by repeated sharing."""
    weight = {k: (5.0, 2.0, 1.0)[i % 3] for i, k in enumerate(sorted(sizes, key=lambda k: (k is None, k or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [k for k in sizes if k not in capped]
        left = total - sum(capped.values())
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if share[k] >= epochs * sizes[k]]
        if not over:
            return {**share, **capped}
        capped |= {k: float(epochs * sizes[k]) for k in over}


def test_mix_reaches_targets(spark):
    rows, df = docs(spark, 900)
    out = mixing.mix(df, extra=("source",)).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    sizes = Counter()
    for i, _, s, *_ in rows:
        sizes[s] += size[i]
    goal = fair(sizes)
    taken = Counter()
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r["size"] * r.copies <= 3 * r["size"]
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - goal[s]) <= 2 * max(size.values()) for s in sizes)
    assert {tuple(r) for r in mixing.mix(df.repartition(3), extra=("source",)).collect()} == {tuple(r) for r in out}


def test_mix_odd_rows(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None, None, None), (1, "", "a", None, None, None), (2, " \t", "b", None, None, None)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.taken == 0 and r.target == 0 for r in out) and len(out) == 3
    same = mixing.mix(spark.createDataFrame([(5, "a b", "s", None, None, None)] * 4, SCHEMA)).collect()
    assert [r.taken for r in same] == [2] * 4


def test_thousands_of_rows_without_id_in_one_source(spark):
    df = spark.range(6000).selectExpr("cast(null as long) doc_id", "concat(repeat('w ', cast(id % 9 as int)), id) text", "'hot' source", "'a' size", "'b' key", "1 target")
    out = sharding.interleave(df).groupBy("shard").count().collect()
    assert sum(r["count"] for r in out) == 6000 and max(r["count"] for r in out) - min(r["count"] for r in out) <= 1
    mixed = mixing.mix(df).collect()
    assert len(mixed) == 6000 and sum(r.taken for r in mixed) <= sum(r["size"] for r in mixed) and all(r.source_size == mixed[0].source_size for r in mixed)


def test_rows_that_differ_in_other_columns_alone_are_the_first_of_them(spark):
    rows = [(1, "a b c", "s", x, None, 1) for x in ("x", "y", "z")] + [(2, "d e", "t", "x", None, 1)]
    out = mixing.mix_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    taken = sum(r.taken for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())
    assert len({r["size"] for r in out if r.doc_id == 1}) == 1 and sum(len(r.text.split()) for r in out) == taken
