"""The distributed algorithms of the core against plain second versions."""

import gzip
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordex.operators import clusters as C
from coordex.operators import correct as K
from coordex.operators import masks as M
from coordex.operators import ranks as R
from coordex.operators import sampling as S
from coordex.operators import stats as T
from coordex.operators import volumes as W


def flood(cells):
    """Labels by flood fill, numbered by first cell."""
    left, out, n = set(cells), {}, 0
    for start in sorted(cells):
        if start not in left:
            continue
        n += 1
        todo = [start]
        left.discard(start)
        while todo:
            c = todo.pop()
            out[c] = n
            for d in range(3):
                for s in (-1, 1):
                    near = tuple(x + s * (a == d) for a, x in enumerate(c))
                    if near in left:
                        left.discard(near)
                        todo.append(near)
    return out


def blob(seed, n=600, side=12, low=-3):
    rng = random.Random(seed)
    return sorted({tuple(rng.randrange(low, low + side) for _ in range(3)) for _ in range(n)})


@pytest.mark.parametrize("tile", [1, 3, 5, 64])
def test_labels_do_not_depend_on_tiles(spark, tile):
    images = {"a": blob(1), "b": blob(2, 1200), "snake": [(i, 0 if i // 2 % 2 else j, 0) for i in range(40) for j in range(3 if i % 4 == 0 else 1)] + [(i, 2, 0) for i in range(0, 40)]}
    images["snake"] = sorted(set(images["snake"]))
    rows = [(n, *c) for n, cells in images.items() for c in cells] + [("a", *images["a"][0]), (None, 1, 1, 1)]
    got = {(r.image_id, r.i, r.j, r.k): r.label for r in C.label_components(spark.createDataFrame(rows, "image_id string, i int, j int, k int"), tile).collect()}
    assert got == {(n, *c): lab for n, cells in images.items() for c, lab in flood(cells).items()}


def pairs_hausdorff(a, b):
    far = lambda x, y: max(min(sum((p - q) ** 2 for p, q in zip(s, t)) for t in y) for s in x)
    return math.sqrt(max(far(a, b), far(b, a)))


@pytest.mark.parametrize("slab", [1, 4, 16])
def test_distance_transform_equals_all_pairs(spark, slab):
    one = {k: blob(10 + k, n) for k, n in enumerate((1, 5, 60, 200))}
    two = {k: blob(20 + k, n, 9, 4) for k, n in enumerate((3, 1, 80, 150))}
    one[9], two[8] = blob(3, 5), blob(4, 5)  # images with one mask only
    far = [(k, *c) for k, cells in one.items() for c in cells], [(k, *c) for k, cells in two.items() for c in cells]
    a, b = (spark.createDataFrame(x, "image_id int, i int, j int, k int") for x in far)
    got = {r.image_id: r.hausdorff for r in M.hausdorff(a, b, slab).collect()}
    assert got == {k: pytest.approx(pairs_hausdorff(one[k], two[k]), abs=1e-12) for k in range(4)}


def test_lower_envelope_with_gaps_and_uneven_places():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.cumsum(rng.integers(1, 5, 12)).astype(float)
        f = np.where(rng.random((6, 12)) < 0.5, np.inf, rng.integers(0, 200, (6, 12)))
        f[0] = np.inf
        want = (f[:, None, :] + (x[:, None] - x[None]) ** 2).min(2)
        assert np.array_equal(M.lower_envelope(f, x), want)


def test_hundred_thousand_voxels_a_mask(spark):
    import time

    ball = lambda cx: spark.range(60 * 60 * 60).select(F.lit("x").alias("image_id"), *[(F.expr(e)).cast("int").alias(c) for c, e in zip("ijk", (f"id div 3600 + {cx}", "id div 60 % 60", "id % 60"))]).where(f"(i - 30 - {cx}) * (i - 30 - {cx}) + (j - 30) * (j - 30) + (k - 30) * (k - 30) <= 841")
    a, b = ball(0), ball(7)
    assert a.count() > 100_000
    began = time.time()
    assert M.hausdorff(a, b).collect()[0].hausdorff == 7.0
    assert time.time() - began < 60


@pytest.mark.parametrize("keep", [3, 4096])
def test_quantiles_equal_sorted_values(spark, keep):
    rng = random.Random(5)
    groups = {"flat": [1.0] * 500, "one": [3.5], "uniform": [rng.random() for _ in range(777)], "wild": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)], "ties": [float(rng.randrange(4)) for _ in range(300)], None: [rng.gauss(0, 1) for _ in range(101)]}
    groups["ends"] = [math.inf, -math.inf] + [rng.random() for _ in range(99)]
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("uniform", None), ("uniform", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"a": 0.25, "b": 0.5, "c": 0.9, "low": 0.0, "high": 1.0}
    got = {r.g: r for r in R.quantiles(df, "x", shares, ("g",), keep).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = sorted(xs)
        for name, p in shares.items():
            at = p * (len(xs) - 1)
            low, high, part = xs[math.floor(at)], xs[math.ceil(at)], at - math.floor(at)
            want = low if low == high else low * (1 - part) + high * part
            assert got[g][name] == want or got[g][name] == pytest.approx(want, rel=1e-12) or math.isnan(want), (g, name)
    everything = R.quantiles(df, "x", {"m": 0.5}, keep=keep).collect()
    assert everything[0].m == sorted(x for xs in groups.values() for x in xs)[sum(map(len, groups.values())) // 2] or len(everything) == 1
    assert R.quantiles(df.where("false"), "x", {"m": 0.5}).collect() == []


def plan(df):
    return df._jdf.queryExecution().toString()


def test_limits_hold_no_buffer_of_values(spark):
    from coordex.operators import agreement as A

    pairs = spark.createDataFrame([("a", float(x), 0.0) for x in range(50)], "Area string, Difference double, Mean double")
    out = A.bland_altman(pairs, "X", ("Area",))
    assert "percentile" not in plan(out) and "median" not in plan(out)
    r = out.collect()[0]
    assert (r.centre, r.limit_hi) == (24.5, 24.5 + 1.5 * 24.5)


def test_running_best_of_one_large_tag(spark):
    rng = random.Random(2)
    rows = [("r", "t", s, rng.uniform(-1, 1) + s / 3000) for s in range(3000)] + [("r", None, 1, -1.0), ("r", None, 2, 0.5), ("r", "u", 1, None), ("r", "u", 2, 1.0)]
    df = S.running_best(spark.createDataFrame(rows, "run_id string, tag string, step long, value double"))
    assert all("_range" in w for w in re.findall(r"windowspecdefinition\(run_id[^)]*", df._jdf.queryExecution().optimizedPlan().toString()))
    got = {(r.tag, r.step): (r.best, r.improved) for r in df.collect()}
    best = {}
    for _, tag, s, v in sorted(rows, key=lambda r: (r[1] or "", r[2])):
        before = best.get(tag, 0.0)
        best[tag] = before if v is None else max(before, v)
        assert got[tag, s] == (best[tag], None if v is None else v > before)
    assert len(got) == len(rows)


def test_ranks_of_skewed_groups(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else None, rng.random(), i) for i in range(2000)]
    got = {r.n: r["rank"] for r in R.ranked(spark.createDataFrame(rows, "g string, x double, n int"), ["g"], ["x"]).collect()}
    for g in ("hot", None):
        assert [got[i] for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])] == list(range(1, sum(r[0] == g for r in rows) + 1))


def test_shapiro_from_ranks_equals_the_plain_one(spark):
    rng = np.random.default_rng(4)
    groups = {str(n): rng.normal(size=n) if n % 2 else rng.exponential(size=n) for n in (3, 4, 5, 6, 11, 12, 50, 777, 4999)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("3", None), ("3", math.nan), ("flat", 1.0), ("flat", 1.0), ("flat", 1.0), ("two", 1.0), ("two", 2.0)]
    rows += [("big", float(x)) for x in rng.normal(size=6000)]
    got = {r.g: r for r in T.shapiro(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    for g, xs in groups.items():
        w, p = T.shapiro_wilk(xs)
        assert (got[g].w, got[g].p_value, got[g].n) == (pytest.approx(w, abs=1e-9), pytest.approx(p, abs=1e-9), len(xs))
    assert got["flat"].w is None and got["two"].w is None and got["big"].p_value is None and 0.99 < got["big"].w <= 1


def test_normal_tables(spark):
    from statistics import NormalDist

    p = [1e-300, 1e-12, 0.001, 0.02, 0.07, 0.3, 0.5, 0.77, 0.999]
    df = spark.createDataFrame([(x, NormalDist().inv_cdf(x)) for x in p], "p double, x double")
    for r in df.select("p", "x", F.expr(T.normal_score("p")).alias("score"), F.expr(T.normal_share("x")).alias("share")).collect():
        assert r.score == pytest.approx(r.x, rel=1e-13, abs=1e-15) and r.share == pytest.approx(r.p, rel=1e-9)


def test_ks_statistic_equals_the_steps(spark):
    rng = random.Random(6)
    xs = [rng.gauss(0.3, 1.2) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    share = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    want = max(max((i + 1) / 300 - share(x), share(x) - i / 300) for i, x in enumerate(sorted(xs)))
    assert T.ks_statistic(df, "x").collect()[0].statistic == pytest.approx(want, abs=1e-12)
    assert T.ks_normal(df, "x").collect()[0].statistic == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("n", "m"), [(1, 1), (4, 4), (4, 6), (7, 7), (12, 12)])
def test_assignment_of_any_number_of_points(spark, n, m):
    rng = random.Random(n * 31 + m)
    tables = [[[rng.uniform(0, 10) for _ in range(m)] for _ in range(n)] for _ in range(6)] + [[[1.0] * m for _ in range(n)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, c array<array<double>>")
    got = {r.i: r.to for r in df.select("i", K.assigned(F.col("c"), n).alias("to")).collect()}
    for i, t in enumerate(tables):
        cost = lambda p: sum(t[e][c] for e, c in enumerate(p))  # noqa: B023, E731
        assert len(set(got[i])) == n and all(0 <= c < m for c in got[i])
        if n <= 7:
            best = min(map(cost, itertools.permutations(range(m), n)))
        else:  # least cost over subsets of columns, row by row
            least = {0: 0.0}
            for e in range(n):
                nxt = {}
                for s, d in least.items():
                    for c in range(m):
                        if not s >> c & 1:
                            k = s | 1 << c
                            nxt[k] = min(nxt.get(k, math.inf), d + t[e][c])
                least = nxt
            best = min(least.values())
        assert cost(got[i]) == pytest.approx(best, abs=1e-9)


def test_resample_equals_a_plain_loop(spark):
    rng = random.Random(8)
    cells = {(rng.randrange(-1, 9), rng.randrange(9), rng.randrange(7)): rng.uniform(-2, 5) for _ in range(200)}
    df = spark.createDataFrame([("x", *c, v) for c, v in cells.items()], "image_id string, i int, j int, k int, v double")
    for matrix in (((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0)), ((0.7, 0.2, -0.1, 1.317), (-0.3, 0.9, 0, 0.511), (0, 0.1, 1.4, -2.03)), ((3, 0, 0, 0), (0, 0, 2, 0), (0, 2, 0, 1))):
        got = {(r.i, r.j, r.k): r.v for r in W.resample(df, matrix, (11, 10, 9), block=4).collect()}
        want = {}
        for p in itertools.product(range(11), range(10), range(9)):
            at = [sum(a * b for a, b in zip(r, p)) + r[3] for r in matrix]
            for ups in itertools.product((0, 1), repeat=3):
                w = math.prod(x - math.floor(x) if u else 1 - x + math.floor(x) for x, u in zip(at, ups))
                c = tuple(math.floor(x) + u for x, u in zip(at, ups))
                if w > 0 and c in cells:
                    want[p] = want.get(p, 0.0) + w * cells[c]
        assert set(got) == set(want) and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_resize_is_a_mean_over_cells(spark):
    rng = np.random.default_rng(9)
    v = rng.random((7, 6, 5))
    df = spark.createDataFrame([("x", *map(int, c), float(v[c])) for c in np.ndindex(v.shape)], "image_id string, i int, j int, k int, v double")
    for new in ((3, 6, 2), (9, 4, 5)):
        got = {(r.i, r.j, r.k): r.v for r in W.resize_area(df, v.shape, new).collect()}
        cut = lambda o, n, m: slice(o * n // m, -(-(o + 1) * n // m))
        assert got == {c: pytest.approx(float(v[tuple(cut(o, n, m) for o, n, m in zip(c, v.shape, new))].mean())) for c in np.ndindex(new)}


def test_mutual_information(spark):
    rng = np.random.default_rng(10)
    v = rng.integers(0, 4, (6, 6, 6)).astype(float)
    make = lambda name, a: [(name, *map(int, c), float(a[c])) for c in np.ndindex(a.shape)]
    df = lambda rows: spark.createDataFrame(rows, "image_id string, i int, j int, k int, v double")
    fixed = df(make("same", v) + make("other", v) + make("flat", np.ones((2, 2, 2))))
    moving = df(make("same", 10 - 2 * v) + make("other", rng.permutation(v.ravel()).reshape(v.shape)) + make("flat", np.ones((2, 2, 2))))
    got = {r.image_id: r.nmi for r in W.mutual_information(fixed, moving, bins=4).collect()}
    assert got["same"] == pytest.approx(2.0) and 1.0 <= got["other"] < 1.1 and got["flat"] is None


def test_blocks_prune_files(spark, tmp_path):
    path = str(tmp_path / "blocks")
    df = spark.range(40 * 40 * 40).select(F.lit("x").alias("image_id"), *[F.expr(e).cast("int").alias(c) for c, e in zip("ijk", ("id div 1600", "id div 40 % 40", "id % 40"))], F.col("id").cast("double").alias("v"))
    W.write_blocks(df, path, zone=16, block=4)
    found = W.read_ball(spark, path, (20.5, 8, 30), 5.0, zone=16)
    want = df.where("(i - 20.5) * (i - 20.5) + (j - 8) * (j - 8) + (k - 30) * (k - 30) <= 25")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*zone", text), text
    files = lambda x: x.select(F.input_file_name().alias("f")).distinct().count()
    assert files(found) < 0.4 * files(spark.read.parquet(path))
    assert W.read_slice(spark, path, "j", 33, (40, 40, 40), zone=16).count() == 1600
    codes = spark.createDataFrame([(3, 5, 6), (0, 0, 0), (1 << 20, 77, (1 << 21) - 1)], "i int, j int, k int").select("*", W.morton(F.col("i"), F.col("j"), F.col("k")).alias("m")).collect()
    assert all(r.m == W.morton_code(r.i, r.j, r.k) for r in codes)


# ---- sources and streams


def test_volumes_as_a_data_source(spark, tmp_path):
    from coordex.sources.nifti import decode, encode
    from coordex.sources.nifti_format import NiftiReader, NiftiSource, head, write_volumes

    spark.dataSource.register(NiftiSource)
    folder = str(tmp_path / "volumes")
    meta = spark.createDataFrame([(n, [9, 8, 7], np.diag([2.0, 1, 1, 1]).tolist()) for n in ("one", "two", "empty")], "image_id string, shape array<int>, affine array<array<double>>")
    rows = [(n, *c, float(sum(c) + 1)) for n, seed in (("one", 1), ("two", 2)) for c in blob(seed, 100, 7, 0)]
    voxels = spark.createDataFrame(rows, "image_id string, i int, j int, k int, v double")
    write_volumes(voxels, meta, folder)
    assert sorted(p.name for p in (tmp_path / "volumes").iterdir()) == ["empty.nii.gz", "one.nii.gz", "two.nii.gz"]

    (tmp_path / "volumes" / "broken.nii").write_bytes(b"x" * 10)
    heads = {r.image_id.rpartition("/")[2]: r for r in spark.read.format("nifti").option("content", "headers").load(folder).collect()}
    assert heads["one.nii.gz"].shape == [9, 8, 7] and heads["two.nii.gz"].affine[0][0] == 2.0 and heads["broken.nii"].error
    back = spark.read.format("nifti").load(folder)
    short = lambda df: sorted((r.image_id.rpartition("/")[2][:-7], r.i, r.j, r.k, r.v) for r in df.collect())
    assert short(back) == sorted(rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        cut = spark.read.format("nifti").option("pushdown", "true").load(folder).where("k >= 2 and k < 5 and j = 3")
        assert short(cut) == sorted(r for r in rows if 2 <= r[3] < 5 and r[2] == 3)
        one = spark.read.format("nifti").option("pushdown", "true").load(folder).where(F.col("image_id") == str(tmp_path / "volumes" / "one.nii.gz"))
        assert short(one) == sorted(r for r in rows if r[0] == "one")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")

    class Counted:
        def __init__(self, data):
            self.data, self.at = data, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            return out

    big = encode(np.random.default_rng(1).random((60, 60, 60)), np.eye(4))
    seen = Counted(big)
    assert head(seen) == gzip.decompress(big)[:352] and seen.at <= 8192 < len(big)
    assert decode(big)[0].shape == (60, 60, 60)
    assert NiftiReader({"path": folder, "glob": "one*"}).partitions()[0].path.endswith("one.nii.gz")

    # A failed write leaves nothing; one that replaces takes the old files away.
    before = sorted(p.name for p in (tmp_path / "volumes").iterdir())
    bad = spark.createDataFrame([("two", 99, 0, 0, 1.0)], voxels.schema)
    with pytest.raises(Exception):
        write_volumes(bad, meta, folder)
    assert sorted(p.name for p in (tmp_path / "volumes").iterdir()) == before
    write_volumes(voxels.where("image_id = 'one'"), meta.where("image_id = 'one'"), folder, mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "volumes").iterdir()) == ["broken.nii", "one.nii.gz"]


@pytest.fixture
def no_idle_batches(spark):
    """Timeouts ask for batches without data, for ever; a stream that ends when all is read has none."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def run_stream(make, source, out, checkpoint):
    q = make(source).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_late_metrics_correct_what_came_before(spark, tmp_path, no_idle_batches):
    from coordex.streaming import state

    rng = random.Random(12)
    rows = [("r", t, s, rng.uniform(-1, 1) + s / 100) for t in ("a", "b", "c") for s in range(60)] + [("r", "a", 3, None), ("r", None, 1, 0.5)]
    rng.shuffle(rows)
    schema, box = "run_id string, tag string, step long, value double", [str(tmp_path / n) for n in ("in", "out", "check")]
    for k in range(0, len(rows), 37):  # out of order, and a new start of the stream for each part
        spark.createDataFrame(rows[k : k + 37], schema).coalesce(1).write.mode("append").parquet(box[0])
        run_stream(state.running_best, spark.readStream.schema(schema).parquet(box[0]), box[1], box[2])
    got = state.standing(spark.read.parquet(box[1]), ["run_id", "tag", "step"], "improved")
    want = S.running_best(spark.createDataFrame([r for r in rows if r[3] is not None], schema)).where("improved").select("run_id", "tag", "step", "best")
    assert sorted(map(tuple, got.fillna("").collect())) == sorted(map(tuple, want.fillna("").collect()))


def test_late_files_correct_the_work_list(spark, tmp_path, no_idle_batches):
    from coordex.sources.inventory import coregistration_jobs
    from coordex.streaming import state

    rng = random.Random(13)
    rows = [(f"s{s}", session, kind, f"/{s}/{session}/{kind}") for s in range(12) for session, kinds in (("base", ["T1"]), ("ses-1", ["Petra_Pre", "Petra_Post"]), ("ses-2", ["Petra_Pre"]), ("ses-3", ["Petra_Post", "T1"])) for kind in kinds if rng.random() < 0.8]
    rows += [("s1", "base", "T1", "/second"), ("s2", "ses-1", "Done", None), ("s3", "ses-2", "Done", None)]
    rng.shuffle(rows)
    schema, box = "subject string, session string, kind string, path string", [str(tmp_path / n) for n in ("in", "out", "check")]
    for k in range(0, len(rows), 11):
        spark.createDataFrame(rows[k : k + 11], schema).coalesce(1).write.mode("append").parquet(box[0])
        run_stream(state.work_list, spark.readStream.schema(schema).parquet(box[0]), box[1], box[2])
    got = state.standing(spark.read.parquet(box[1]), ["subject", "session", "pre", "post", "reference"], "planned")
    files = spark.createDataFrame(rows, schema)
    want = coregistration_jobs(files.where("kind <> 'Done'"), files.where("kind = 'Done'")).select("subject", "session", F.col("Petra_Pre").alias("pre"), F.col("Petra_Post").alias("post"), "reference")
    assert sorted(map(tuple, got.fillna("").select(*want.columns).collect())) == sorted(map(tuple, want.fillna("").collect())) != []


def test_work_list_by_the_rule(spark):
    from coordex.sources.inventory import coregistration_jobs

    rows = [("a", "base", "T1"), ("a", "s1", "Petra_Pre"), ("a", "s1", "Petra_Post"), ("a", "s2", "Petra_Pre"), ("a", "s3", "Petra_Post"), ("a", "base", "Petra_Pre"), ("b", "s1", "Petra_Pre"), ("b", "s1", "T1"), ("c", "base", "T1"), ("c", "base", "T1"), ("c", "s1", "Petra_Pre")]
    files = spark.createDataFrame([(*r, f"/{i}") for i, r in enumerate(rows)], "subject string, session string, kind string, path string")
    got = {(r.subject, r.session, r.Petra_Pre, r.Petra_Post, r.reference) for r in coregistration_jobs(files, files.where("false")).collect()}
    assert got == {("a", "s1", "/1", "/2", "/0"), ("a", "s2", "/3", None, "/0"), ("c", "s1", "/10", None, "/8"), ("c", "s1", "/10", None, "/9")}
    assert coregistration_jobs(files, files.where("session = 's1'")).count() == 1
