"""Zstandard web archives: written and read as files of WARC 1.1 records.

An archive begins with a skippable frame that holds the dictionary; each record is a frame of its own after it. The writer makes
its frames in the tasks that hold the pages, and Spark's text writer puts them into files, so any store that Spark writes to
will do, and only a task that succeeds leaves a file. Its line separator is an empty skippable frame, which every decoder passes over.

Of records with equal payloads, one is the response and the others revisit it. Which payloads occur again is found from digests
alone; a bitmap of them keeps all other pages out of the join that names the response.

The reader loads the dictionary from the leading frame, walks from frame to frame by their block headers, decodes one
frame for each record, and checks the record's version, mandatory fields, lengths and digests. A file is read by one task, up to the
2 GB that Spark's reader of whole files takes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, in_sieve, sieve

#: Fixed values of the formats.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: An empty skippable frame, as text: what stands between frames.
BETWEEN = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
#: The dictionary is trained on so many pages, drawn by hash, of each so many bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 512, 4096, 1 << 15, 3
#: Bytes of frames that a task hands over at once.
HANDED = 4 << 20
#: Equal rows that one task writes out.
UNFOLDED = 1000
DATE = "2024-01-01T00:00:00Z"

RECORDS = "path string, offset long, record_type string, record_id string, target_uri string, date string, page_id long, refers_to_id string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sampled payloads; where they are too few to train one, the payloads themselves."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One record; fields that are None are left out."""
    fields = fields | {"WARC-Block-Digest": f"sha1:{_sha1(block)}", "Content-Length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None, page_id: int | None) -> str:
    """The page's address with what no header can hold quoted; one of its own where there is none."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"


def _page(row: dict, date: str) -> bytes:
    first, size = row["ref"] is None, row["size"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if first else "revisit",
        "WARC-Record-ID": _record_id(row["sha256"], row["page_id"], row["url"], row["nth"]),
        "WARC-Date": date,
        "WARC-Target-URI": _uri(row["url"], row["page_id"]),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode(),
        "X-Page-Id": row["page_id"],
    }
    if not first:
        ref = row["ref"]
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(row["sha256"], ref["page_id"], ref["url"], 0), "WARC-Refers-To-Target-URI": _uri(ref["url"], ref["page_id"]), "WARC-Refers-To-Date": date, "WARC-Truncated": "length"}
    return record(fields | {"Content-Type": "application/http;msgtype=response"}, head + (row["html"] or b"" if first else b""))


def _frames(dictionary: bytes, date: str):
    """Pages to the frames of one archive: the dictionary, a record about the archive, a record for each page."""

    def run(batches):
        held, size = [], 0
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **options)

        def frames() -> Iterator[bytes]:
            begun = False
            for batch in batches:
                for row in batch.to_pylist():
                    raw = _page(row, date)
                    if not begun:
                        begun = True
                        if dictionary:
                            yield struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary
                        about = {"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id("archive", raw), "WARC-Date": date, "Content-Type": "application/warc-fields"}
                        yield packer.compress(record(about, b"format: WARC File Format 1.1\r\n"))
                    yield packer.compress(raw)

        for frame in frames():
            held.append(frame)
            size += len(frame)
            if size > HANDED:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    return run


def _decided(pages: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Pages with ``ref``: null for a response, else the page_id and url of the response that the page revisits; and ``nth`` among equal rows."""
    html = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    raw = raw.withColumns({"sha256": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    long = raw.where(F.col("size") >= least)
    equal = long.groupBy("sha256", "page_id", "url").agg(F.count("*").alias("n"))
    again = equal.groupBy("sha256").agg(F.sum("n").alias("times"), F.max(F.struct("page_id", "url", "n")).alias("top")).where("times > 1")
    again = scratch.cut(again.select("sha256", F.xxhash64("sha256").alias("key"), F.struct("top.page_id", "top.url").alias("top"), F.col("top.n").alias("n")))
    keyed = raw.withColumns({"key": F.xxhash64("sha256"), "sha1": F.sha1("html")})
    keyed = in_sieve(keyed, "key", scratch.cut(sieve(again, "key")))
    columns = ["page_id", "url", "html", "sha256", "sha1", "size"]
    none, once = F.lit(None).cast("struct<page_id:bigint,url:string>").alias("ref"), F.lit(0).cast("long").alias("nth")
    # short ones may be equal rows, all of them responses
    out = keyed.where("not __tl_in").select(*columns, none, (once if least < 1 else F.when(F.col("size") < least, F.monotonically_increasing_id()).otherwise(F.lit(0))).alias("nth"))
    met = keyed.where("__tl_in").select(*columns).join(again.select("sha256", "top", "n"), "sha256", "left")
    top = F.expr("top is not null and page_id <=> top.page_id and url <=> top.url").alias("is_top")
    met = met.select(*columns, "top", "n", top)
    nth = F.when(F.col("top").isNull() | F.col("is_top"), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    out = out.unionByName(met.where("not is_top or n = 1").select("page_id", "url", F.when(F.col("top").isNull() | F.col("is_top"), F.col("html")).alias("html"), "sha256", "sha1", "size", F.when(~F.col("is_top"), F.col("top")).alias("ref"), nth.cast("long").alias("nth")))
    if not again.where("n > 1").isEmpty():
        # whole rows that repeat: one of them is the response, the others are counted out
        first = scratch.cut(met.where("is_top and n > 1").groupBy("sha256").agg(*[F.any_value(c).alias(c) for c in (*columns, "top", "n") if c != "sha256"]))
        runs = first.drop("html").withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 2) div {UNFOLDED})"))).repartition("sha256", "run")
        more = runs.withColumn("nth", F.explode(F.expr(f"sequence(run * {UNFOLDED} + 1, least((run + 1) * {UNFOLDED}, n - 1))")))
        out = out.unionByName(first.select(*columns, none, once)).unionByName(more.select("page_id", "url", F.lit(None).cast("binary").alias("html"), "sha256", "sha1", "size", F.col("top").alias("ref"), "nth"))
    return out


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Write pages (page_id, url, html) as archives below ``path``, one for each partition that holds any.

    The payload is the html in UTF-8; null html is an empty payload. Of payloads of at least ``least`` bytes that are equal, that of the
    largest page_id (null least; ties by url) is a response and the others are revisits without a payload; whole rows that
    repeat are records of their own. Pages without an address get one from their id. Empty and very long pages are like others;
    an empty table gives no archives; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    few = pages.select(F.xxhash64("page_id", "url", F.monotonically_increasing_id()).alias("draw"), F.substring(F.col("html").cast("string").cast("binary"), 1, SAMPLE_BYTES).alias("html"))
    share = min(1.0, 2 * SAMPLE / max(1, pages.count()))  # so that a task passes on a few rows, not as many as the whole sample
    sample = few.where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("draw").limit(SAMPLE).select("html").collect()
    dictionary = train([bytes(r["html"]) for r in sample if r["html"]])
    frames = _decided(pages, least, scratch).mapInArrow(_frames(dictionary, date), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def frames(raw: memoryview) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, magic number, frame) of each frame of an archive; a skippable one without its header."""
    at = 0
    while at < len(raw):
        if len(raw) - at < 8:
            raise ValueError(f"at {at}: the archive ends within a frame")
        magic, size = struct.unpack_from("<II", raw, at)
        if magic & ~15 == SKIPPABLE:
            begin, end = at + 8, at + 8 + size
        elif magic == FRAME:
            head = bytes(raw[at : at + 18])
            begin, end, last = at, at + zstandard.frame_header_size(head), False
            while not last:
                if end + 3 > len(raw):
                    raise ValueError(f"at {at}: the archive ends within a frame")
                block = int.from_bytes(raw[end : end + 3], "little")
                last = bool(block & 1)
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            end += 4 * zstandard.get_frame_parameters(head).has_checksum
        else:
            raise ValueError(f"at {at}: no frame begins with {magic:08x}")
        if end > len(raw):
            raise ValueError(f"at {at}: the archive ends within a frame")
        yield at, magic, raw[begin:end]
        at = end


def dictionary_of(raw: memoryview) -> bytes:
    """The dictionary of an archive, from its leading skippable frame; it may be compressed itself. Empty if there is none."""
    if len(raw) < 8 or struct.unpack_from("<I", raw)[0] != DICTIONARY:
        return b""
    held = bytes(next(frames(raw))[2])
    if held[:4] == struct.pack("<I", FRAME):
        return zstandard.ZstdDecompressor().decompressobj().decompress(held)
    return held


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name is not None:
            out[name] += " " + line.strip().decode()
            continue
        key, colon, value = line.partition(b":")
        if not colon or not NAME.fullmatch(key):
            raise ValueError(f"no header field: {line[:80]!r}")
        name = key.decode().lower()
        out.setdefault(name, value.strip().decode())
    return out


def _length(fields: dict[str, str]) -> int:
    n = fields.get("content-length", "")
    if not (n.isascii() and n.isdigit()):
        raise ValueError(f"the length is no number: {n!r}")
    return int(n)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes | None, int]:
    """(fields, block, payload, length of the full payload) of one record; whatever isn't as the format asks is a ValueError."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version not in VERSIONS or not blank:
        raise ValueError(f"no record begins with {raw[:16]!r}")
    fields = _fields(lines)
    if missing := [f for f in MANDATORY if not fields.get(f)]:
        raise ValueError(f"missing fields: {missing}")
    n = _length(fields)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block should be of {n} bytes and end the record, and {len(rest)} bytes follow the header")
    block = rest[:n]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{_sha1(block)}":
        raise ValueError("the block's digest differs")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return fields, block, None, 0
    if kind == "revisit" and not (fields.get("warc-refers-to") and fields.get("warc-profile") and fields.get("warc-payload-digest")):
        raise ValueError("a revisit must name its profile, the record it refers to and the payload's digest")
    payload, size = block, len(block)
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        status, blank, payload = block.partition(b"\r\n\r\n")
        status, *lines = status.split(b"\r\n")
        if not status.startswith(b"HTTP/") or not blank:
            raise ValueError(f"no HTTP response begins with {status[:16]!r}")
        http = _fields(lines)
        size = _length(http) if "content-length" in http else len(payload)
    if kind == "response" and size != len(payload):
        raise ValueError(f"the payload should be of {size} bytes and has {len(payload)}")
    if kind == "response" and fields.get("warc-payload-digest", f"sha1:{_sha1(payload)}") != f"sha1:{_sha1(payload)}":
        raise ValueError("the payload's digest differs")
    return fields, block, payload if kind == "response" else None, size


def _read(path: str, raw: memoryview, with_payload: bool) -> Iterator[dict]:
    dictionary = dictionary_of(raw)
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    unpack = zstandard.ZstdDecompressor(**options)
    for at, magic, frame in frames(raw):
        if magic != FRAME:
            continue
        try:
            whole = unpack.decompressobj()
            fields, _, payload, size = parse(whole.decompress(frame))
            if not whole.eof:
                raise ValueError("the frame doesn't end")
            page = fields.get("x-page-id")
            digest = fields.get("warc-payload-digest", "") if payload is None else f"sha1:{_sha1(payload)}"
            yield {
                "path": path, "offset": at, "record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"], "page_id": None if page is None else int(page),
                "refers_to_id": fields.get("warc-refers-to"), "payload_digest": digest.partition(":")[2] or None, "payload_bytes": size, "payload": payload if with_payload else None, "fields": list(fields.items()),
            }
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"{path}, record at {at}: {e}") from e


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``: see RECORDS. Fields are by lower-case name.

    Without ``payload`` the column is null; digests and lengths are checked all the same. A revisit's payload_bytes is the length that
    its HTTP header states. A record that isn't as the format asks fails the query, with its archive and place.
    """
    kinds = {"path": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "date": pa.string(), "page_id": pa.int64(), "refers_to_id": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string())}
    schema = pa.schema(kinds)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for r in _read(name, memoryview(content.as_buffer()), payload):
                    held.append(r)
                    size += 1000 + len(r["payload"] or b"")
                    if size > HANDED:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """Page records with ``refers_to``, the page_id of the response that a revisit refers to: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit whose response is missing, or has another length or digest, fails the query.
    """
    pages = records.where("record_type in ('response', 'revisit')")
    first = pages.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    met = pages.where("record_type = 'revisit'").join(first, "refers_to_id", "left")
    same = F.coalesce((F.col("n") == F.col("payload_bytes")) & (F.col("d") == F.col("payload_digest")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("no response for the revisit "), "record_id"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    revisits = met.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(wrong)).select(*names, "refers_to")
    return pages.where("record_type = 'response'").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def archived(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back: see ``write_archives`` and ``resolve``."""
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    path = f"{scratch.root}/archives"
    write_archives(pages, path)
    if pages.isEmpty():
        return resolve(spark.createDataFrame([], RECORDS))
    return resolve(scratch.cut(read_archives(spark, path, payload=False)))
