import base64
import gzip
import hashlib
from pathlib import Path

from tracewell.llm import warc_chain as c

PAGES = "page_id long, url string, html string"
FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def sample():
    rows = [(k, f"http://a.b/{k}", f"<p>page {k % 7} é</p>" * (k % 5 + 1)) for k in range(60)]
    rows += [(60, None, None), (61, "u", ""), (62, "x\r\ny", "before " + FAKE + " after"), (63, "u", FAKE * 3), (64, "u", "WARC/1.0\r\n"), (65, "u", "before " + FAKE + " after")]
    return rows


def want(rows, least=0):
    best = {}
    for page, _, text in rows:
        best[text or ""] = max(page, best.get(text or "", page))
    out = {}
    for page, _, text in rows:
        size = len((text or "").encode())
        first = best[text or ""] if size >= least else page
        out[page] = (size, sha(text), "response" if first == page else "revisit", None if first == page else first)
    return out


def test_round_trip_with_magic_in_payloads(spark):
    rows = sample()
    got = c.report(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want(rows) and len(got) == len(rows)


def test_small_payloads_are_all_responses(spark):
    rows = sample()
    got = c.archived(spark.createDataFrame(rows, PAGES), least_bytes=20).collect()
    assert {r.page_id: (r.bytes, r.digest, r.kind, r.refers_to) for r in got} == want(rows, 20)
    assert all(r.sound for r in got)


def test_files_are_plain_records_in_order(spark, tmp_path):
    rows = sample()
    c.write(spark.createDataFrame(rows, PAGES).repartition(3), str(tmp_path / "w"), records_per_file=8)
    files = sorted(Path(tmp_path / "w").glob("*.gz"))
    total = 0
    for file in files:
        data = gzip.decompress(file.read_bytes())
        at = number = 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\nWARC-Type: ")
            size = int(head.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
            at += len(head) + 4 + size
            assert data[at:at + 4] == b"\r\n\r\n"
            at, number = at + 4, number + 1
        assert number <= 8
        total += number
    assert total == len(rows) and c.read(spark, str(tmp_path / "w")).count() == len(rows)


def test_only_the_chain_from_the_start_is_reached(spark):
    rows = [("f", 0, 10), ("f", 5, 10), ("f", 10, 30), ("f", 20, 30), ("f", 30, 99), ("g", 0, None), ("g", 7, 9), ("h", 3, 4), *[("k", k, k + 1) for k in range(70)]]
    got = {(r.file, r.at) for r in c.reached(spark.createDataFrame(rows, "file string, at long, next long")).collect()}
    assert got == {("f", 0), ("f", 10), ("f", 30), ("g", 0), *[("k", k) for k in range(70)]}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "b", "x"), (None, "c", "y"), (2, "d", "z"), (2, "e", "w")]
    got = c.report(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("1", "response", "None")] * 2 + [("None", "revisit", "1"), ("None", "response", "None")] + [("2", "response", "None")] * 2)
    assert c.report(spark.createDataFrame([], PAGES)).count() == 0


def test_base32(spark):
    frame = spark.createDataFrame([("",), ("abc",), ("é" * 50,)], "t string")
    rows = frame.select("t", c.base32_of(c.F.sha1(frame.t.cast("binary"))).alias("d")).collect()
    assert all(r.d == sha(r.t) for r in rows)


def block(kind, body, version="1.1", **fields):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in fields.items()], f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    page = b"<p>hello</p>" + FAKE.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    told = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    records = [
        block("warcinfo", b"software: x\r\n", "1.0", WARC_Record_ID="<urn:uuid:1>"),
        block("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<urn:uuid:2>", Content_Type="application/http; msgtype=request"),
        block("response", http, WARC_Record_ID="<urn:uuid:3>", WARC_Target_URI="http://a.b/\r\n  folded", Content_Type="application/http; msgtype=response", WARC_Payload_Digest=told),
        block("response", http, WARC_Record_ID="<urn:uuid:4>", Content_Type="application/http", WARC_Payload_Digest="sha1:" + "A" * 32),
        block("metadata", FAKE.encode() * 2, WARC_Record_ID="<urn:uuid:5>")]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = c.read(spark, str(tmp_path)).collect()
    for name in ("members.warc.gz", "one.warc.gz", "plain.warc"):
        own = sorted((r for r in rows if r.file.endswith("/" + name)), key=lambda r: r.at)
        assert [r.kind for r in own] == ["warcinfo", "request", "response", "response", "metadata"]
        assert [r.record_id for r in own] == [f"<urn:uuid:{k}>" for k in range(1, 6)]
        assert [r.sound for r in own] == [True, True, True, False, True] and own[2].uri == "http://a.b/ folded"
        assert own[2].bytes == len(page) and own[2].digest == told[5:] and own[1].bytes == 0
    assert len(rows) == 15
