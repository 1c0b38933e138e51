import hashlib

import zstandard

from coordex.llm import warc as W
from coordex.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, bytes int"


def brute(rows):
    best = {}
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        if p not in best or (i is not None and (best[p] is None or i > best[p])):
            best[p] = i
    out = []
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        lead = best[p]
        out.append((i, len(p), W.base32(hashlib.sha1(p).hexdigest()), "response" if i == lead else "revisit", None if i == lead else lead))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r)[:5] for r in W.archive(df).collect()], key=str)


def test_matches_brute_force(spark):
    rows = [(i, f"http://h/{i} ü" if i % 3 else None, f"<p>{'text é ' * (i % 11)}</p>", "d", 1) for i in range(90)]
    rows += [(200, None, None, None, None), (201, "u", "", None, 1), (202, "u", "z" * 300_000, None, 1), (None, "u", "only", None, 1)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_repeated_rows_have_one_response(spark):
    rows = W.archive(spark.createDataFrame([(1, "u", "same", None, None)] * 3 + [(0, "v", "same", None, None)], SCHEMA)).collect()
    assert sorted(r.record_type for r in rows) == ["response", "revisit", "revisit", "revisit"]
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {1}


def test_empty_table(spark):
    assert W.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_format(spark):
    rows = [(i, f"http://h/{i}", f"<html>{i} common words here again</html>", None, None) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = scratch_path(spark, "format")
    index = W.write_archives(df, path, W.dictionary_of(df)).collect()
    assert len(index) == 30
    data = open(index[0].archive.removeprefix("file://"), "rb").read()
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    size = int.from_bytes(data[4:8], "little")
    d = zstandard.ZstdDecompressor(dict_data=W._dict_data(data[8 : 8 + size]))
    one = d.decompress(data[index[5].position : index[5].position + index[5].length])
    fields = W.parse_record(one)
    assert one.startswith(b"WARC/1.1\r\n") and fields["WARC-Record-ID"] == f"<urn:page:{index[5].page_id}:0>"
    assert len(list(W.read_archive(data))) == 30
    records = {r.page_id: bytes(r.payload).decode() for r in W.read_archives(spark, path).collect()}
    assert records == {r[0]: r[2] for r in rows}


def test_revisits_hold_no_payload():
    r = W.parse_record(W.warc_record(4, 0, None, b"abc", "D", "urn:page:9:0"))
    assert r["WARC-Type"] == "revisit" and r["payload"] == b"" and r["payload_length"] == 3


def test_hot_payloads_ties_and_null_ids(spark):
    rows = [(i, f"http://h/{i}", "hot page", None, None) for i in range(300)] + [(299, "http://h/z", "hot page", None, None), (299, None, "hot page", None, None)]
    rows += [(None, None, "hot page", None, None)] * 5 + [(None, "a", "nameless", None, None)] * 4 + [(None, "b", "nameless", None, None)]
    out = W.archive(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(out) == len(rows) and {r.payload_bytes for r in out} == {8}
    one = {k: [r for r in out if r.record_type == "response" and r.payload_digest == W.base32(hashlib.sha1(k.encode()).hexdigest())] for k in ("hot page", "nameless")}
    assert [(r.page_id, r.url) for r in one["hot page"]] == [(299, "http://h/z")] and [(r.page_id, r.url) for r in one["nameless"]] == [(None, "b")]
    assert {r.refers_to for r in out if r.record_type == "revisit" and r.page_id is not None} == {299}


def test_attempts_do_not_meet(tmp_path):
    uri = f"file://{tmp_path}/a.warc.zst"
    one, two = W.ArchiveWriter(uri, b""), W.ArchiveWriter(uri, b"")
    assert one.part != two.part
    for w in (one, two):
        w.add(W.warc_record(1, 0, "u", b"same", "D", None))
    one.close()
    two.close()
    assert [p.name for p in tmp_path.iterdir()] == ["a.warc.zst"] and len(list(W.read_archive((tmp_path / "a.warc.zst").read_bytes()))) == 1


def test_what_a_lost_attempt_leaves_is_not_read(spark, tmp_path):
    path = "file://" + str(tmp_path / "w")
    df = spark.createDataFrame([(i, f"u{i}", "page " * i, None, None) for i in range(40)], SCHEMA)
    dead = W.ArchiveWriter(f"{path}/part-000000-0000-{'0' * 32}.warc.zst", b"")
    dead.add(W.warc_record(7, 0, "u7", b"other payload", "A" * 32, None))
    dead.close()
    rows = W.archive(df, path).collect()
    assert sorted(r.page_id for r in rows) == list(range(40)) and {r.record_type for r in rows} == {"response"}
    assert len({p.name for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc.zst")}) > 1


def test_a_page_that_comes_thousands_of_times_is_one_of_the_sample(spark):
    df = spark.range(5000).selectExpr("cast(null as long) page_id", "cast(null as string) url", "repeat('same words here ', 2000) html")
    other = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50) for i in range(30)], "page_id long, url string, html string")
    assert len(W.dictionary_of(df.unionByName(other))) < W.SAMPLE_BYTES
