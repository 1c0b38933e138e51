"""Hand-computed micro-fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordex.config import ELECTRODES, FULL, HALF, LONG, MEASUREMENTS
from coordex.functions import geometry as G
from coordex.functions import text as X
from coordex.operators import agreement as A
from coordex.operators import clusters as C
from coordex.operators import correct as K
from coordex.operators import masks as M
from coordex.operators import reshape as R
from coordex.operators import sampling as S
from coordex.operators import stats as T


def vox(spark, rows, image="a"):
    return spark.createDataFrame([(image, *r, 1.0) for r in rows], "image_id string, i int, j int, k int, v double")


def stats(spark, sizes):
    return spark.createDataFrame([("a", i + 1, n, (0.0, 0.0, float(i))) for i, n in enumerate(sizes)], "image_id string, label int, size long, com struct<i:double,j:double,k:double>")


def test_components_are_face_connected(spark):
    rows = [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 1, 1), (3, 3, 3)]
    found = sorted(C.cluster_stats(C.label_components(vox(spark, rows))).collect(), key=lambda r: r.label)
    assert [(r.label, r.size) for r in found] == [(1, 3), (2, 1), (3, 1)]
    assert (found[0].com.i, found[0].com.j, found[0].com.k) == (0, pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_labels_match_a_flood_fill():
    rng = random.Random(5)
    for _ in range(30):
        cells = sorted({(rng.randrange(5), rng.randrange(5), rng.randrange(4)) for _ in range(rng.randrange(1, 60))})
        label, n = {}, 0
        for c in cells:
            if c in label:
                continue
            n += 1
            todo = [c]
            while todo:
                x = todo.pop()
                if x in label or x not in cells:
                    continue
                label[x] = n
                todo += [tuple(x[d] + (s if d == e else 0) for d in range(3)) for e in range(3) for s in (-1, 1)]
        order = list(cells)
        rng.shuffle(order)
        got = C.component_labels(*[np.array(a) for a in zip(*order)])
        assert got.tolist() == [label[c] for c in order]


@pytest.mark.parametrize(("sizes", "kept", "name"), [([100] * 4 + [20, 1], 5, "more_than_four"), ([100] * 4 + [1], 4, "four_clusters"), ([6] * 4 + [1], 5, "more_than_four"), ([3, 1, 1], 3, "three_clusters")])
def test_size_filter(spark, sizes, kept, name):
    rows = C.filter_clusters(stats(spark, sizes))
    assert rows.count() == kept
    assert C.validate_configuration(rows, rows.select("image_id")).first()["class"] == name


def test_empty_image_is_counted(spark):
    checked = C.validate_configuration(stats(spark, [5]), spark.createDataFrame([("a",), ("none",)], "image_id string"))
    report = {r.counter: r.value for r in C.extraction_report(checked).collect()}
    assert report["processed_images"] == 2 and report["no_clusters"] == 1 and report["one_cluster"] == 1 and report["invalid_configurations"] == 2


@pytest.mark.parametrize(("points", "valid"), [([(0, 0, 0), (70, 0, 0), (0, 5, 0), (0, 0, 6)], True), ([(0, 0, 0), (0, 0, 4), (0, 0, 80), (50, 0, 0)], False)])
def test_hub(spark, points, valid):
    df = spark.createDataFrame([("a", i + 1, 1, tuple(map(float, p))) for i, p in enumerate(points)], "image_id string, label int, size long, com struct<i:double,j:double,k:double>")
    row = C.validate_configuration(df, df.select("image_id")).first()
    assert row.valid is valid


def points(half, full, extra=()):
    rows = [("P1", "s", "1", "r", "h", HALF, e, d, x if d == "X" else 0.0) for e, x in zip(ELECTRODES, half) for d in "XYZ"]
    rows += [("P1", "s", "1", "r", "n", FULL, e, d, x if d == "X" else 0.0) for e, x in zip(ELECTRODES, full) for d in "XYZ"]
    return rows + list(extra)


def full_x(df):
    return [r.Coordinates for r in sorted(df.where((F.col("Method") == FULL) & (F.col("Dimension") == "X")).collect(), key=lambda r: r.Electrode)]


@pytest.mark.parametrize(("half", "full", "want"), [([0, 10, 20, 30], [10, 0, 20, 30], [0, 10, 20, 30]), ([0, 10, 20, 30], [6, 100, 20, 30], [6, 6, 20, 30]), ([0, 1, 20, 30], [50, 0, 20, 30], [0, 20, 30, 50])])
def test_greedy_correction(spark, half, full, want):
    df = spark.createDataFrame(points(map(float, half), map(float, full)), MEASUREMENTS)
    assert full_x(K.correct_electrodes(df)) == want


def test_assignment_is_a_permutation(spark):
    df = spark.createDataFrame(points([0.0, 10.0, 20.0, 30.0], [6.0, 100.0, 20.0, 30.0]), MEASUREMENTS)
    assert sorted(full_x(K.correct_electrodes(df, mode="assignment"))) == [6, 20, 30, 100]


def test_groups_without_a_method_stay(spark):
    df = spark.createDataFrame([r for r in points([0.0] * 4, [5.0, 1.0, 2.0, 3.0]) if r[5] == FULL], MEASUREMENTS)
    assert full_x(K.correct_electrodes(df)) == [5, 1, 2, 3]


def greedy_in_python(h, f):
    used, to = set(), []
    for e in range(4):
        c = min((c for c in range(4) if c not in used), key=lambda c: math.dist(h[e], f[c]))
        if c != e:
            used.add(c)
        to.append(c)
    return to


def test_greedy_matches_plain_python(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(60):
        h, f = ([[float(rng.randrange(6)) for _ in range(3)] for _ in range(4)] for _ in range(2))
        want[str(g)] = greedy_in_python(h, f)
        for m, p in ((HALF, h), (FULL, f)):
            rows += [("P1", str(g), "1", "r", "x", m, e, d, p[i][k]) for i, e in enumerate(ELECTRODES) for k, d in enumerate("XYZ")]
    got = {r.Subject: r.to for r in K.matching(spark.createDataFrame(rows, MEASUREMENTS)).collect()}
    assert got == want


def test_null_rater_stays(spark):
    df = spark.createDataFrame([("excluded",), ("other",), (None,)], "Rater string")
    assert {r.Rater for r in K.without_raters(df, ("excluded",)).collect()} == {"other", None}


def pairs(spark, differences):
    return spark.createDataFrame([("s", "1", str(i), "rOTC", "Anode", float(d), 0.0, float(d)) for i, d in enumerate(differences)], "Subject string, Session string, run string, Area string, Electrode string, m1 double, m2 double, Difference double")


def test_limits_of_agreement(spark):
    r = A.bland_altman(pairs(spark, [1, 0, -1, 1, 20]), "X").first()
    assert (r.bias, r.sd) == (pytest.approx(4.2), pytest.approx(8.8713, abs=1e-4))
    assert (r.loa_hi, r.loa_lo) == (pytest.approx(21.5878, abs=1e-4), pytest.approx(-13.1878, abs=1e-4))
    assert (r.centre, r.limit_hi, r.limit_lo) == (1, 2.5, -0.5)
    report = A.loa_report(pairs(spark, [1, 0, -1, 1, 20]), "X").first()
    assert (report.total, report.within_n, report.outside_n) == (5, 5, 0)
    assert A.report_text(A.loa_report(pairs(spark, [1, 0]), "X")).count() == 3


def test_single_pair_has_no_limits(spark):
    r = A.bland_altman(pairs(spark, [3]), "Euclidean_Norm").first()
    assert r.sd is None and r.loa_hi is None
    assert A.outliers(pairs(spark, [3]), "X").count() == 0


def test_within_and_outside_add_up(spark):
    rng = random.Random(2)
    r = A.loa_report(pairs(spark, [rng.gauss(0, 1) for _ in range(100)] + [9, -9]), "X").first()
    assert r.within_n + r.outside_n == r.total == 102 and r.outside_n >= 2


def test_icc(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0], [1.5, 2.0, 2.5, 4.5])), "m1 double, m2 double")
    r = T.icc11(df).first()
    assert (r.msb, r.msw, r.icc) == (pytest.approx(3.28125), pytest.approx(0.09375), pytest.approx(0.944444, abs=1e-6))
    assert T.icc11(df, "m2", "m1").first().icc == pytest.approx(r.icc)


def f_density(d1, d2):
    z = np.linspace(0, 1, 2_000_001)[1:-1]
    log = (d1 / 2 - 1) * np.log(z) + (d2 / 2 - 1) * np.log1p(-z) + math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)
    return d2 * z / (d1 * (1 - z)), np.exp(log) * (z[1] - z[0])


def test_f_distribution():
    for d1, d2 in ((3, 4), (19, 20), (2, 7), (124, 125)):
        values, mass = f_density(d1, d2)
        for f in (0.3, 1.0, 2.5):
            assert T.f_share(f, d1, d2) == pytest.approx(mass[values > f].sum(), abs=1e-4)
        for share in (0.025, 0.5, 0.975):
            assert T.f_share(T.f_quantile(share, d1, d2), d1, d2) == pytest.approx(1 - share, abs=1e-9)
    assert T.f_share(3.0, 2, 10) == pytest.approx((1 + 2 * 3 / 10) ** -5)  # closed form for two degrees
    assert T.f_share(1.0, 10**7, 10**7) == pytest.approx(0.5, abs=1e-6)


def test_icc_interval(spark):
    df = spark.createDataFrame([*zip("aaaa", [1.0, 2.0, 3.0, 4.0], [1.5, 2.0, 2.5, 4.5]), ("b", 1.0, 2.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0)], "g string, m1 double, m2 double")
    r = {x.g: x for x in T.icc_interval(T.icc11(df, by=("g",))).collect()}
    a = r["a"]
    assert a.lower < a.icc < a.upper and 0 < a.p_value < 0.01
    low = a.f / T.f_quantile(0.975, 3, 4)
    assert a.lower == pytest.approx((low - 1) / (low + 1))
    assert (r["b"].p_value, r["b"].lower, r["c"].lower, r["c"].upper) == (None, None, None, None)
    assert T.icc_interval(T.icc11(df.where("g = 'x'"), by=("g",))).count() == 0


def test_orthogonal_slices_are_turned_left(spark):
    rng = np.random.default_rng(8)
    volume = rng.random((4, 5, 6))
    rows = [("s", int(i), int(j), int(k), float(v)) for (i, j, k), v in np.ndenumerate(volume)]
    points = spark.createDataFrame([("s", 1, 2, 3, [4, 5, 6]), ("none", 0, 0, 0, [1, 1, 1])], "image_id string, i int, j int, k int, shape array<int>")
    got = M.orthogonal_slices(spark.createDataFrame(rows, "image_id string, i int, j int, k int, v double"), points).collect()
    planes = {"axial": volume[:, :, 3], "sagittal": volume[:, 2, :], "coronal": volume[1, :, :]}
    want = {("s", p, r, c, v) for p, m in planes.items() for (r, c), v in np.ndenumerate(np.rot90(m))}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_shapiro_tells_normal_from_skewed():
    rng = np.random.default_rng(1)
    assert T.shapiro_wilk(rng.normal(size=200))[1] > 0.05
    assert T.shapiro_wilk(rng.exponential(size=200))[1] < 1e-4
    w, p = T.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))  # a textbook sample
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.007, abs=0.002)
    assert T.shapiro_wilk(np.array([1.0, 1.0, 1.0])) == (None, None)


def test_mask_metrics(spark):
    a, b = vox(spark, [(0, 0, k) for k in range(3)]), vox(spark, [(0, 0, k) for k in range(1, 4)])
    r = M.mask_metrics(a, b).first()
    assert (r.dice, r.iou, r.hausdorff) == (pytest.approx(4 / 6), 0.5, 1.0)
    assert M.overlap(a, b.limit(0)).first().dice is None
    assert M.surface(vox(spark, [(i, j, k) for i in range(3) for j in range(3) for k in range(3)])).count() == 26


def test_affine_there_and_back(spark):
    m = "array(array(-1d,0d,0d,90d),array(0d,1d,0d,-126d),array(0d,0d,1d,-72d),array(0d,0d,0d,1d))"
    df = spark.sql(f"select {m} a, array(10d,20d,30d) v, array(87.5d,-123.5d,-71.5d) w")
    r = df.select(G.apply_affine(F.col("a"), F.col("v")).alias("x"), G.inverse_affine(F.col("a"), G.apply_affine(F.col("a"), F.col("v"))).alias("y"), G.world_to_voxel(F.col("a"), F.col("w")).alias("z")).first()
    assert (r.x, r.y, r.z) == ([80, -106, -42], [10, 20, 30], [2, 2, 0])


def test_vector_text(spark):
    df = spark.createDataFrame([("[ 1.5  -2. 3e-1]",), ("[]",), (None,), ("[a 1 2]",)], "t string")
    assert [r.v for r in df.select(X.parse_vector(F.col("t")).alias("v")).collect()] == [[1.5, -2.0, 0.3], None, None, [None, 1.0, 2.0]]


def test_backfill_and_recode(spark):
    rows = [("P1", "a", "run-01", "x"), ("YourExperimentName", "a", "baseline", HALF), ("YourExperimentName", "b", "run-01", HALF)]
    out = A.normalize_measurements(spark.createDataFrame(rows, "Experiment string, Subject string, run string, Method string"))
    got = {(r.Subject, r.run): (r.Experiment, r.Method) for r in out.collect()}
    assert got == {("a", "run-01"): ("P1", "x"), ("a", "baseline"): ("P1", "baseline"), ("b", "run-01"): (None, "semi-automated")}


def test_union_keeps_extra_columns_and_duplicates(spark):
    one = spark.createDataFrame([("P1", "s", "1", "r", "n", FULL, "Anode", "X", 1.0)] * 2, MEASUREMENTS)
    out = R.merge_measurements(one, one.withColumn("date", F.lit("d")))
    assert out.columns == [*LONG, "date"] and out.count() == 4 and out.where("date is null").count() == 2


def test_round_trip_of_shapes(spark):
    rows = [("s", "1", "r", *[[float(e), float(e) + 0.5, -1.0] for e in range(4)])]
    wide = spark.createDataFrame(rows, "subject string, session string, run string, anode_mni array<double>, cathode1_mni array<double>, cathode2_mni array<double>, cathode3_mni array<double>")
    assert R.to_long(wide).count() == 12
    assert tuple(R.to_wide(R.to_long(wide)).first()) == rows[0]


def test_path_parts(spark):
    df = spark.createDataFrame([("/m/sub-001/unzipped/sub-001_ses-1_run-01/mask.nii.gz",), ("/x/y.nii",)], "p string")
    rows = df.select(X.path_parts(F.col("p")).alias("k")).collect()
    assert tuple(rows[0].k) == ("001", "1", "01") and rows[1].k is None
    r = spark.createDataFrame([("/d/rsub-07_ses-2_acq-petra_run-01_PDw.nii",)], "p string").select(X.name_parts(F.col("p")).alias("k"), X.canonical_subject(F.lit("rsub-07")).alias("s")).first()
    assert tuple(r.k) == ("07", "2", "01") and r.s == "sub-07"


def test_chained_keys_shrink(spark):
    rows = [(e, s, "1", "r", rater, m, "Anode", d, 1.0) for s, ms in (("a", (FULL, "semi-automated", "manually")), ("b", (FULL, "semi-automated")), ("c", (FULL, "manually"))) for m in ms for rater in (["Network"] if m == FULL else ["h"]) for e in ("P1",) for d in "XYZ"]
    steps = A.agreement_sequence(spark.createDataFrame(rows, MEASUREMENTS), ("h",), coi=("X", "Y"))
    keys = [{r.Subject for r in p.collect()} for *_, p in steps]
    assert keys[0] == {"a", "b"} and all(x >= y for x, y in zip(keys, keys[1:])) and keys[-1] == {"a"}
    loose = A.agreement_sequence(spark.createDataFrame(rows, MEASUREMENTS), ("h",), coi=("X",), chained=False)
    assert {r.Subject for r in loose[1][3].collect()} == {"a", "c"}


def test_split(spark):
    out = S.split_dataset(spark.range(20), "id", 8, 8)
    first = {r.id: r.subset for r in out.collect()}
    assert sorted(first.values()) == ["test"] * 8 + ["train"] * 4 + ["validation"] * 8
    assert first == {r.id: r.subset for r in S.split_dataset(spark.range(20).repartition(3), "id", 8, 8).collect()}


def test_running_best_is_strict(spark):
    m = spark.createDataFrame([("r", "t", i, v) for i, v in enumerate([-1.0, 0.0, 2.0, 2.0, 3.0])], "run_id string, tag string, step long, value double")
    assert [r.improved for r in S.running_best(m).orderBy("step").collect()] == [False, False, True, False, True]
    assert S.best_step(m).first().step == 4


def test_sphere_and_overlay(spark):
    c = spark.createDataFrame([("a", 5, 5, 5, [8, 8, 8]), ("b", 0, 0, 0, [8, 8, 8])], "image_id string, i int, j int, k int, shape array<int>")
    counts = {r.image_id: r["count"] for r in M.sphere(c).groupBy("image_id").count().collect()}
    assert counts == {"a": 33, "b": 11}
    r = M.overlay(vox(spark, [(0, 0, 0)]), vox(spark, [(0, 0, 0)])).first()
    assert (r.r, r.g) == (1.0, 0.5)


def test_shapes_and_scaling(spark):
    meta = spark.createDataFrame([("a", [224, 288, 288]), ("b", [1, 2, 3]), ("c", None)], "image_id string, shape array<int>")
    ok, bad = M.matching_shape(meta)
    assert [r.image_id for r in ok.collect()] == ["a"] and bad.count() == 2
    assert M.minmax(vox(spark, [(0, 0, 0)])).first().scaled is None


def test_create_dataset(spark):
    from coordex.operators.sampling import create_dataset
    from coordex.sources.inventory import with_keys

    volumes = with_keys(spark.createDataFrame([(f"/d/rsub-{i:03d}_ses-1_acq-petra_run-01_PDw.nii",) for i in range(12)], "path string"))
    masks = with_keys(spark.createDataFrame([(f"/m/sub-{i:03d}_ses-1_run-01/mask.nii.gz",) for i in range(10)], "path string"))
    out = create_dataset(volumes, masks, 2, 3).collect()
    assert len(out) == 10 and sorted(r.subset for r in out) == ["test"] * 3 + ["train"] * 5 + ["validation"] * 2
    with pytest.raises(ValueError):
        create_dataset(volumes, masks.where("false"), 2, 3)
