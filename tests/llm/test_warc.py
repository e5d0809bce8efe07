import base64
import gzip
import hashlib
import io
import os

import pytest

from wayfarer.llm import warc as W
from wayfarer.session import scratch_path

PAGES = [(1, "http://a/1", "x" * 150), (2, None, "x" * 150), (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://a\r\n/5", None), (6, "", "é\r\n\r\n" * 60), (None, "u", "x" * 150), (None, "u", "solo" * 40), (7, "u", "é\r\n\r\n" * 60), (1, "http://a/1", "x" * 150), (8, "u", "long " * 40000)]


def expected():
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        ids = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        revisit = len(data) >= 100 and ids and len([1 for p in PAGES if p[2] == html]) > 1 and i != min(ids)
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", str(min(ids)) if revisit else "None"))
    return sorted(out)


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, record_type string")
    folder = scratch_path(spark, "warc-test")
    files = W.write_archives(df, folder, file_bytes=300)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in W.read_archives(files).collect())
    assert got == expected()
    names = [f for f in os.listdir(folder) if not f.startswith(".")]
    assert len(names) == files.count() > 1
    assert all(gzip.open(f"{folder}/{n}").read().startswith(b"WARC/1.1\r\n") for n in names)
    assert W.read_archives(W.write_archives(df.where("false"), scratch_path(spark, "warc-none"))).count() == 0


def test_members_and_damage():
    parts = [gzip.compress(bytes([65 + i]) * 70000 * i + b"end") for i in range(4)]
    assert [m[-3:] for m in W.members(io.BytesIO(b"".join(parts)))] == [b"end"] * 4
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(b"".join(parts)[:-5])))
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(parts[1] + b"not gzip at all")))
    record = W.response_record(3, "http://a", b"payload")
    assert W.parse_record(record).payload == b"payload"
    for bad in (record.replace(b"payload\r\n", b"paYload\r\n"), record[:-6], record.replace(b"WARC/1.1", b"CRAW/1.1")):
        with pytest.raises(ValueError):
            W.parse_record(bad)


def foreign(kind, block, content=None, **fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"content-length: {len(block)}"]
    return "\r\n".join([*head, *([f"Content-Type: {content}"] if content else [])]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    http = "application/http; msgtype=response"
    body = b"<html>chunks</html>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<html\r\ne;x=y\r\n>chunks</html>\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x\r\n", "application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "application/http; msgtype=request", WARC_Target_URI="http://a"),
        foreign("response", chunked, http, WARC_Payload_Digest=sha1(body), WARC_Block_Digest=sha1(chunked), WARC_Record_ID="<urn:uuid:1>"),
        foreign("response", b"HTTP/1.0 200 OK\nA: b\n\nplain", http, WARC_Payload_Digest="xyz:unknown"),
        foreign("metadata", b"", None),
        foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", http, WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest=sha1(body)),
        foreign("resource", b"text", "text/plain", WARC_Payload_Digest="sha256:" + hashlib.sha256(b"text").hexdigest()),
    ]
    found = [W.parse_record(r) for r in records]
    assert [r.kind for r in found] == ["warcinfo", "request", "response", "response", "metadata", "revisit", "resource"]
    assert found[2].payload == body and found[3].payload == b"plain" and found[6].payload == b"text" and found[5].payload_bytes is None
    with pytest.raises(ValueError):
        W.parse_record(foreign("response", chunked, http, WARC_Payload_Digest=sha1(b"other")))
    assert len(list(W.parse_records(b"".join(records)))) == 7
    folder = scratch_path(spark, "warc-foreign")
    os.makedirs(folder)
    with open(f"{folder}/a.warc.gz", "wb") as out:
        out.write(b"".join(map(gzip.compress, records)))
    files = spark.createDataFrame([(W.qualified(spark, f"{folder}/a.warc.gz"), None, "x")], "path string, records long, date string")
    got = W.read_archives(files).collect()
    assert len(got) == 7 and {r.url for r in got} == {None, "http://a"} and {r.page_id for r in got} == {None}


def test_record_ids_stay_apart():
    ids = {W.parse_record(W.response_record(i, "u", b"x", p)).record_id for i, p in ((None, "1.1.0"), (None, "1.1.1"), (3, "1.1.2"), (3, "1.1.3"))}
    assert len(ids) == 4
    assert W.parse_record(W.response_record(3, "u", b"y" * 100, "1.1.4")).record_id == "<urn:page:3>"


@pytest.mark.parametrize("kept", [1, 5, 9, 10, 12, 20, -1])
def test_a_cut_last_member_is_an_error(kept):
    pack = lambda n: gzip.compress(W.response_record(n, "u", b"x" * 200))
    whole = pack(1) + pack(2)
    assert len(list(W.members(io.BytesIO(whole)))) == 2
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(pack(1) + pack(2)[:kept])))
