import base64
import glob
import hashlib
import struct
from collections import defaultdict

import pytest
import zstandard

from trackloom.llm import warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = "page_id long, url string, html string, record_type string, key long"


def sha1(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def brute(rows):
    same = defaultdict(list)
    for page, url, html in rows:
        same[(html or "").encode()].append((page is not None, page or 0, url is not None, url or "", page))
    out = []
    for raw, pages in same.items():
        *others, top = sorted(pages)
        out += [(p[-1], len(raw), sha1(raw), "revisit", top[-1]) for p in others] + [(top[-1], len(raw), sha1(raw), "response", None)]
    return sorted(map(repr, out))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "q", 3) for r in rows], SCHEMA)


def archived(df):
    return sorted(repr(tuple(r)) for r in warc.archived(df).select(*COLUMNS).collect())


def test_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert archived(df) == brute(rows)
    again = df.unionByName(df.selectExpr("page_id + 1000 as page_id", "url", "html").where("page_id % 3 = 0")).repartition(5)
    assert archived(again) == brute([tuple(r) for r in again.select("page_id", "url", "html").collect()])


def test_edge_rows(spark):
    rows = [(1, "http://a\r\nX: y z", "same"), (2, None, "same"), (2, None, "same"), (2, "u", "same"), (None, "a", None), (None, None, ""), (3, "é", "x" * 3_000_000), (4, "q", "\x00ü\r\n\r\nWARC/1.1\r\n"), (5, "", "(µ/ý")]
    rows += [(9, "z", "repeated")] * 2300
    assert archived(frame(spark, rows).repartition(3)) == brute(rows)
    assert archived(frame(spark, rows).limit(0)) == []
    assert archived(frame(spark, [(None, None, None)])) == brute([(None, None, None)])


def test_records(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    copies = df.limit(40).selectExpr("page_id - 5000 as page_id", "concat('copy/', url) as url", "html")
    warc.write_archives(df.unionByName(copies), f"{tmp_path}/out")
    got = warc.read_archives(spark, f"{tmp_path}/out").collect()
    pages = {r["page_id"]: r for r in df.collect()}
    first = {r["page_id"]: r for r in got if r["record_type"] == "response"}
    assert sorted(first) == sorted(pages) and all(bytes(r["payload"]).decode() == (pages[p]["html"] or "") for p, r in first.items())
    assert all(r["target_uri"] == pages[p]["url"] for p, r in first.items())
    again = [r for r in got if r["record_type"] == "revisit"]
    assert len(again) == 40 and all(r["payload"] is None and r["fields"]["warc-profile"] == warc.PROFILE and r["refers_to_id"] == first[r["page_id"] + 5000]["record_id"] for r in again)
    assert len({r["record_id"] for r in got}) == len(got)
    assert all(r["payload"] is None for r in warc.read_archives(spark, f"{tmp_path}/out", payload=False).collect())


def test_archives_are_plain_zstandard_files(spark, sf, tmp_path):
    warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet").repartition(3), f"{tmp_path}/out")
    files = glob.glob(f"{tmp_path}/out/part-*")
    assert len(files) == 3
    for f in files:
        raw = open(f, "rb").read()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == warc.DICTIONARY
        found = list(warc.frames(memoryview(raw)))
        assert found[0][0] == 0 and bytes(found[0][2]) == raw[8 : 8 + size] == warc.dictionary_of(memoryview(raw))
        records = [x for x in found if x[1] == warc.FRAME]
        with zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).stream_reader(raw[8 + size :], read_across_frames=True) as r:
            whole = r.read()  # another way through the same bytes
        assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(records)


def pack(tmp_path, *records, dictionary=b"", packed=False, name="a.warc.zst"):
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    held = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    head = struct.pack("<II", warc.DICTIONARY, len(held)) + held if dictionary else b""
    (tmp_path / name).write_bytes(head + b"".join(zstandard.ZstdCompressor(**options).compress(r) for r in records))


FIELDS = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": "http://a/", "Content-Type": "text/plain"}


def test_archives_of_others(spark, tmp_path):
    r = warc.record(FIELDS, b"plain block")
    folded = r.replace(b"WARC-Target-URI: http://a/", b"warc-target-uri: http://a/\r\n b").replace(b"WARC/1.1", b"WARC/1.0")
    pack(tmp_path, r, folded, name="none.warc.zst")
    pack(tmp_path, r, dictionary=b"WARC/1.1 plain block response" * 9, packed=True, name="packed.warc.zst")
    raw = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compress(r)
    (tmp_path / "stream.warc.zst").write_bytes(struct.pack("<II", warc.SKIPPABLE + 3, 2) + b"hi" + raw)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(bytes(x["payload"]) == b"plain block" and x["payload_digest"] == sha1(b"plain block") and x["page_id"] is None for x in got)
    assert sorted(x["target_uri"] for x in got) == ["http://a/"] * 3 + ["http://a/ b"]


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "no record begins"),
        (lambda r: r.replace(b"WARC-Date", b"X-Date"), "missing fields"),
        (lambda r: r.replace(b"Content-Length: 52", b"Content-Length: 51"), "the block should be of 51 bytes"),
        (lambda r: r.replace(b"Content-Length: 52", b"Content-Length: -1"), "no number"),
        (lambda r: r[:-2], "the block should be"),
        (lambda r: r + r, "the block should be"),
        (lambda r: r.replace(b"hello", b"hullo"), "block's digest differs"),
        (lambda r: r.replace(b"WARC-Target-URI:", b"WARC-Target-URI"), "missing|no header field"),
        (lambda r: r.replace(b"Content-Length: 13", b"Content-Length: 12").replace(b"WARC-Block", b"X-Block"), "payload should be of 12 bytes"),
        (lambda r: r.replace(b"HTTP/1.1", b"GTTP/1.1").replace(b"WARC-Block", b"X-Block"), "no HTTP response"),
        (lambda r: r.replace(b"sha1:AAAA", b"sha1:BBBB"), "payload's digest differs"),
    ],
)
def test_what_is_wrong_is_said(change, said):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 13\r\n\r\nhello, world!"
    good = warc.record(FIELDS | {"Content-Type": "application/http;msgtype=response"}, block)
    assert b"Content-Length: 52" in good and warc.parse(good)[2] == b"hello, world!"
    if "payload's digest" in said:
        good = warc.record(FIELDS | {"WARC-Payload-Digest": "sha1:AAAA", "Content-Type": "application/http"}, block)
    with pytest.raises(ValueError, match=said):
        warc.parse(change(good))


def test_broken_archives(spark, tmp_path):
    r = warc.record(FIELDS, b"x" * 1000)
    pack(tmp_path, r, r)
    raw = (tmp_path / "a.warc.zst").read_bytes()
    for cut in (raw[:-1], raw[: len(raw) // 2 + 3], raw + b"junk", raw + b"junkjunkjunk"):
        with pytest.raises(ValueError, match="archive ends within a frame|no frame begins"):
            list(warc.frames(memoryview(cut)))
    (tmp_path / "a.warc.zst").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="archive ends within a frame"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_a_revisit_without_its_response(spark, tmp_path):
    fields = FIELDS | {"WARC-Type": "revisit", "WARC-Profile": warc.PROFILE, "WARC-Refers-To": "<urn:x:none>", "WARC-Payload-Digest": f"sha1:{sha1(b'')}"}
    pack(tmp_path, warc.record(fields, b""))
    with pytest.raises(Exception, match="no response for the revisit"):
        warc.resolve(warc.read_archives(spark, str(tmp_path))).collect()


def test_short_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "a", "ab"), (2, "b", "ab"), (2, "b", "ab"), (3, "c", "long enough"), (4, "d", "long enough")]
    warc.write_archives(frame(spark, rows), f"{tmp_path}/out", least=5)
    got = warc.resolve(warc.read_archives(spark, f"{tmp_path}/out")).select("page_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)], key=str)
