import numpy as np

from coordex.config import FULL, MEASUREMENTS
from coordex.sources import inventory as I
from coordex.sources import nifti as N
from coordex.sources import tables as T
from coordex.streaming import incremental as S

AFFINE = np.array([[-1.0, 0, 0, 90], [0, 1, 0, -126], [0, 0, 1, -72], [0, 0, 0, 1]])


def test_nifti_round_trip():
    v = np.arange(24, dtype="i2").reshape(2, 3, 4)
    for compress in (True, False):
        got, affine = N.decode(N.encode(v, AFFINE, compress))
        assert np.array_equal(got, v) and np.allclose(affine, AFFINE)
    turned, affine = N.canonical(v, AFFINE)
    assert np.array_equal(turned, v[::-1]) and affine[0, 0] == 1 and affine[0, 3] == 89


def test_volumes_in_and_out(spark, tmp_path):
    v = np.zeros((4, 4, 4), "u1")
    v[1, 2, 3] = v[0, 0, 0] = 1
    at = tmp_path / "sub-001"
    at.mkdir()
    (at / "sub-001_ses-1_run-01_mask.nii.gz").write_bytes(N.encode(v, AFFINE))
    (at / "sub-002_ses-1_run-01_mask.nii.gz").write_bytes(b"broken")
    meta = N.read_images(spark, str(tmp_path))
    rows = {r.subject: r for r in meta.collect()}
    assert rows["001"].shape == [4, 4, 4] and rows["001"].affine == AFFINE.tolist() and rows["002"].error
    voxels = N.read_voxels(spark, str(tmp_path))
    assert sorted((r.i, r.j, r.k) for r in voxels.collect()) == [(0, 0, 0), (1, 2, 3)]
    out = N.write_masks(voxels, meta.where("error is null"), f"file://{tmp_path}/out").collect()
    got, affine = N.decode(open(out[0].path, "rb").read())
    assert np.array_equal(got, v) and np.allclose(affine, AFFINE)


def test_inventory(spark, tmp_path):
    for p in ("sub-001/ses-base/x_mprage_T1w.nii.gz", "sub-001/ses-1/sub-001_ses-1_petra_run-01_PDw.nii.gz", "sub-001/ses-1/sub-001_ses-1_petra_run-02_PDw.nii.gz", "sub-001/unzipped/sub-001_ses-1_run-01_inference.nii.gz", "sub-123456/ses-1/sub-123456_ses-1_petra_run-01_PDw.nii.gz"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    files = I.inventory(spark, str(tmp_path))
    assert {r.kind for r in files.collect()} == {"T1", "Petra_Pre", "Petra_Post", "Inference"}
    assert {r.subject for r in I.subjects(files).collect()} == {"001"}
    none = files.limit(0)
    jobs = I.coregistration_jobs(files, none).collect()
    assert [(r.subject, r.session) for r in jobs] == [("001", "1")]
    assert I.coregistration_jobs(files, files).count() == 0
    assert I.deletable(files).count() == 1 and files.count() == 5
    assert I.nested(files).count() == 2 and I.folders(files).count() == 4
    assert I.unmatched(files.where("kind = 'Petra_Pre'"), none).count() == 2
    assert I.to_process(files, files, ["path"]).count() == 0 and I.to_process(files, files, ["path"], True).count() == 5


def test_csv_and_reports(spark, tmp_path):
    rows = [("P1", "s", "1", "r", "n", FULL, "Anode", "X", 1.5), ("P1", "s", "1", "r", "n", FULL, "Anode", "Y", float("nan"))]
    T.write_csv(spark.createDataFrame(rows, MEASUREMENTS), f"{tmp_path}/m")
    got = T.read_measurements(spark, f"{tmp_path}/m").orderBy("Dimension").collect()
    assert [r.Coordinates for r in got] == [1.5, None]
    wide = spark.createDataFrame([("s", "1", "r", *[[1.0, -2.5, 3e-7]] * 4)], "subject string, session string, run string, anode_mni array<double>, cathode1_mni array<double>, cathode2_mni array<double>, cathode3_mni array<double>")
    T.write_positions(wide, f"{tmp_path}/p")
    assert T.read_positions(spark, f"{tmp_path}/p").first().cathode3_mni == [1.0, -2.5, 3e-7]
    lines = T.counter_lines(spark.createDataFrame([("valid_configurations", 3)], "counter string, value long"))
    assert lines.first().value == "Valid configurations: 3"


def test_archive_of_pairs(spark, tmp_path):
    import tarfile

    df = spark.createDataFrame([("1", "1", "01", b"m", b"vol")], "subject string, session string, run string, mask binary, volume binary").coalesce(1)
    r = T.write_pairs_archive(df, f"file://{tmp_path}/tar").first()
    with tarfile.open(r.path) as t:
        assert sorted(x.name.rpartition("/")[2] for x in t.getmembers()) == ["mask.nii.gz", "volume.nii.gz"]


def test_streams_see_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    seen = []
    handle = lambda df, _: seen.extend(r.name for r in df.collect())
    for name in ("sub-1_ses-1_run-01_mask.nii", "sub-2_ses-1_run-01_mask.nii"):
        (src / name).write_bytes(b"x")
        S.process_new(S.new_files(spark, str(src)), f"{tmp_path}/ck", handle).awaitTermination()
    assert seen == ["sub-1_ses-1_run-01_mask.nii", "sub-2_ses-1_run-01_mask.nii"]
    spark.createDataFrame([("P1", "s", "1", "r", "n", FULL, "Anode", "X", 2.0)] * 3, MEASUREMENTS).write.parquet(f"{tmp_path}/m")
    q = S.running_counts(S.new_measurements(spark, f"{tmp_path}/m")).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select n, mean from counts").first() == (3, 2.0)
