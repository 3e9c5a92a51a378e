import gzip
import time
import zlib

from graphlode.llm import warc


def rec(kind, rid, to=(), block=b"x", uri="http://u/"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(block)}\r\n"
    return (head + "".join(f"WARC-Concurrent-To: {t}\r\n" for t in to) + "\r\n").encode() + block + b"\r\n\r\n"


def captures(spark, raw):
    df = spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in raw], "record binary")
    out = {}
    for r in warc.assemble(warc.parse_records(df)).collect():
        out[r.capture_id] = (r.request and r.request.record_id, r.response and r.response.record_id, [m.record_id for m in r.metadata], [m.record_id for m in [*r.requests, *r.responses]])
    return out


def test_links_in_every_direction(spark):
    raw = [
        rec("response", "r1", ["q1"]), rec("request", "q1"), rec("metadata", "m1", ["q1"]), rec("metadata", "m0", ["m1"]),
        rec("response", "r2"), rec("request", "q2", ["r2"]), rec("metadata", "m2", ["q2", "r2"]),
        rec("request", "q3"), rec("metadata", "m3", ["q3"]), rec("response", "r4"), rec("warcinfo", "w"), None, b"junk", b"WARC/1.0 no end",
    ]
    assert captures(spark, raw) == {
        "r1": ("q1", "r1", ["m0", "m1"], []), "r2": ("q2", "r2", ["m2"], []), "m3": ("q3", None, ["m3"], []), "r4": (None, "r4", [], []),
    }


def test_further_and_repeated_records(spark):
    raw = [rec("response", "r1"), rec("response", "r1"), rec("revisit", "r0", ["r1"], b"again"), rec("resource", "r9", ["r1"]), rec("request", "q2", ["r1"]), rec("request", "q1", ["r1"]), rec("metadata", "m", ["missing"]), rec("request", "q7", ["missing"])]
    assert captures(spark, raw) == {"r1": ("q1", "r1", [], ["q2", "r0", "r9"]), "m": ("q7", None, ["m"], [])}


def test_files(spark, tmp_path):
    raw = [rec("response", "a", block=b"line\r\n\r\nWARC/1.0 inside"), rec("request", "b", ["a"], block=b"")]
    (tmp_path / "plain.warc").write_bytes(b"".join(raw))
    (tmp_path / "z.warc.gz").write_bytes(b"".join(gzip.compress(x.replace(b"-ID: a", b"-ID: c").replace(b"-To: a", b"-To: c").replace(b"-ID: b", b"-ID: d")) for x in raw))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.block) for r in rows) == [("a", b"line\r\n\r\nWARC/1.0 inside"), ("b", b""), ("c", b"line\r\n\r\nWARC/1.0 inside"), ("d", b"")]
    assert sorted(r.capture_id for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()) == ["a", "c"]


def test_contents_of_further_records_stay(spark):
    raw = [rec("revisit", "a", ["b"], b"first"), rec("response", "b", block=b"main"), rec("request", "q1", ["b"], b"one"), rec("request", "q2", ["b"], b"two")]
    (row,) = warc.assemble(warc.parse_records(spark.createDataFrame([(bytearray(x), "x", 1) for x in raw], "record binary, kind string, g int"))).collect()
    assert (row.capture_id, row.response.block, row.request.block) == ("b", b"main", b"one")
    assert [x.block for x in row.responses] == [b"first"] and [x.block for x in row.requests] == [b"two"]


def test_nulls_and_clashing_columns(spark):
    records = warc.parse_records(spark.createDataFrame([(bytearray(rec("response", "r")),), (bytearray(rec("request", "q", ["r"])),), (bytearray(b""),)], "record binary"))
    odd = records.selectExpr("*", "'x' AS kind", "1 AS g", "2 AS node", "3 AS capture_id").withColumn("concurrent_to", warc.F.concat("concurrent_to", warc.F.array(warc.F.lit(None).cast("string")))).unionByName(records.limit(1).selectExpr("CAST(NULL AS STRING) AS record_id", "type", "target_uri", "date", "content_type", "CAST(NULL AS ARRAY<STRING>) AS concurrent_to", "headers", "block", "'x' AS kind", "1 AS g", "2 AS node", "3 AS capture_id"))
    assert [(r.capture_id, r.request.record_id) for r in warc.assemble(odd).collect()] == [("r", "q")]


def names(data):
    return [warc.parse(x)["record_id"] for x in warc.split_file(data)]


def test_members_of_many_records():
    raw = [rec("response", f"r{i}", block=b"x" * i) for i in range(50)]
    assert names(gzip.compress(b"".join(raw))) == names(b"".join(raw)) == [f"r{i}" for i in range(50)]
    assert names(b"".join(gzip.compress(b"".join(raw[i : i + 7])) for i in range(0, 50, 7))) == [f"r{i}" for i in range(50)]
    assert names(gzip.compress(b"".join(raw)[:300]) + gzip.compress(b"".join(raw)[300:])) == [f"r{i}" for i in range(50)]


def test_damaged_files():
    a, b, c = (rec("response", x, block=b"line\r\n\r\nWARC inside") for x in "abc")
    assert names(b"") == names(b"junk") == names(b"WARC/1.0 no end") == []
    assert names(a.replace(b"Length: 19", b"Length: abc") + b) == ["a", "b"]
    assert warc.parse(next(warc.split_file(a.replace(b"Content-Length: 20\r\n", b"") + b)))["block"] == b"line\r\n\r\nWARC inside"
    assert names(b"junk\n\r\n" + a + b"more junk\r\n" + b) == ["a", "b"]
    assert names(a + b[: len(b) - 12]) == ["a", "b"]
    zipped = [gzip.compress(x) for x in (a, b, c)]
    assert names(b"".join(zipped)[:-20])[:2] == ["a", "b"]
    broken = bytearray(zipped[1])
    broken[12:40] = bytes(28)
    assert names(zipped[0] + bytes(broken) + zipped[2]) == ["a", "c"]


def test_reading_takes_time_in_proportion():
    raw = b"".join(rec("response", f"r{i}", block=b"y" * 1500) for i in range(20_000))
    began = time.perf_counter()
    assert len(list(warc.split_file(raw))) == 20_000
    assert len(list(warc.split_file(zlib.compress(raw, 1, 31)))) == 20_000
    assert time.perf_counter() - began < 10


def test_files_opened_by_tasks(spark, tmp_path):
    (tmp_path / "plain.warc").write_bytes(b"".join(rec("response", f"r{i}") for i in range(2500)))
    rows = warc.read_warc(spark, str(tmp_path), lambda p: open(p.removeprefix("file:"), "rb"))
    assert rows.count() == 2500
