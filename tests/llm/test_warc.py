import hashlib

from pyspark.sql import functions as F

from sensorhealth.llm import warc

PAGES = "page_id bigint, url string, html string, warc_type string, payload string"


def archived(spark, tmp_path, rows, name="a"):
    path = f"file://{tmp_path}/{name}"
    warc.archive(spark.createDataFrame(rows, PAGES), path)
    return path


def test_duplicates_become_revisits(spark, tmp_path):
    big, odd = "é" * 600, "x" * 999
    rows = [
        (1, "http://a/%20?ü\r\n#", big, "own", "own"), (2, "u2", big, None, None), (5, None, big, None, None),
        (5, "again", big, None, None), (3, "u3", odd, None, None), (4, "u4", odd, None, None),
        (6, "u6", None, None, None), (7, "u7", "", None, None), (None, "u8", "n" * 2000, None, None),
        (9, "u9", "l" * 3_000_000, None, None), (10, "u10", "\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08", None, None),
    ]
    path = archived(spark, tmp_path, rows)
    got = sorted(
        (r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"])
        for r in warc.inventory(spark, path).collect()
    )
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for page, _, html, *_ in rows:
        size = len((html or "").encode())
        revisit = html == big and page != 5
        want.append((page or 0, "revisit" if revisit else "response", 5 if revisit else None, size, sha(html)))
    assert got == sorted(want, key=lambda r: r[:2])
    urls = [r["target_uri"] for r in warc.read(spark, path, payload=False).collect()]
    assert sorted(urls, key=str) == sorted((r[1] for r in rows), key=str)


def test_predicates_reach_the_reader(spark, tmp_path):
    path = archived(spark, tmp_path, [(i, f"http://h{i % 3}/{i}", "t" * (100 + i), None, None) for i in range(60)])
    rows = warc.read(spark, path)
    plan = rows.filter("warc_type = 'response' and target_uri like 'http://h1/%'")
    assert plan.count() == 20
    assert "PushedFilters: []" not in plan._jdf.queryExecution().toString()
    assert rows.filter(F.col("record_id").isin("urn:page:3", "urn:page:4")).count() == 2
    assert rows.filter("warc_type = 'revisit'").count() == 0
    assert rows.filter("payload_bytes > 150").count() == 9
    assert warc.read(spark, path, payload=False).filter("payload is not null").count() == 0


def test_empty_table(spark, tmp_path):
    assert warc.inventory(spark, archived(spark, tmp_path, [])).collect() == []


def test_step_over_members_without_lengths(tmp_path):
    import gzip

    import pyarrow.fs as pafs

    row = {"warc_type": "response", "record_id": "r", "target_uri": "u", "refers_to": None, "payload_digest": "00" * 20}
    one = warc._record(row | {"payload": b"a" * 500_000, "payload_bytes": None})
    two = warc._record(row | {"record_id": "s", "payload": b"b", "payload_bytes": None})
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + warc._member(two, 6))
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as f:
        found = list(warc.records(f, lambda r: r["record_id"] == "s", True))
    assert [r["payload"] for r in found] == [b"b"]


def test_appends_and_overwrites(spark, tmp_path):
    pages = lambda *ids: spark.createDataFrame([(i, f"u{i}", f"t{i}", None, None) for i in ids], PAGES)
    path = f"file://{tmp_path}/grown"
    told = lambda: sorted(r["page_id"] for r in warc.inventory(spark, path).collect())
    warc.archive(pages(1), path)
    warc.archive(pages(2, 3), path)
    assert told() == [1, 2, 3]
    warc.archive(pages(4), path, mode="overwrite")
    assert told() == [4]
    warc.archive(pages(5), path)
    assert told() == [4, 5]
    assert len([f for f in (tmp_path / "grown").iterdir() if f.name.endswith(".warc.gz")]) == 2


def test_foreign_archives(spark, tmp_path):
    import gzip

    row = {"warc_type": "response", "record_id": "r", "target_uri": "u", "refers_to": None, "payload_digest": "ab" * 20}
    one = warc._record(row | {"payload": b"x" * 9000 + b"\r\n\r\n", "payload_bytes": None})
    digest = one[one.index(b"sha1:") : one.index(b"sha1:") + 37]
    hexed, odd = one.replace(digest, b"SHA1:" + b"AB" * 20), one.replace(digest, b"md5:00")
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "a.warc").write_bytes(one + hexed)
    (folder / "b.warc.gz").write_bytes(gzip.compress(odd))
    (folder / "c.warc.gz").write_bytes(b"")
    (folder / "d.warc").write_bytes(b"")
    got = [(r["payload_digest"], len(r["payload"])) for r in warc.read(spark, f"file://{folder}").collect()]
    assert sorted(got, key=str) == sorted([("ab" * 20, 9004), ("ab" * 20, 9004), (None, 9004)], key=str)
    sizes = warc.read(spark, f"file://{folder}", payload=False).select("payload_bytes", "payload").distinct().collect()
    assert [tuple(r) for r in sizes] == [(9004, None)]
    for name in ("a.warc", "b.warc.gz"):
        (folder / name).unlink()
    assert warc.read(spark, f"file://{folder}").collect() == []


def test_lengths_beyond_32_bits_are_left_out(monkeypatch):
    import zlib

    class Huge(bytes):
        def __len__(self):
            return 1 << 32

    member = warc._member(Huge(b"abc"), 1)
    assert member[3] == 0 and zlib.decompressobj(-15).decompress(member[10:]) == b"abc"
