"""Conversion of legacy ARC archives to WARC, and reading WARC archives back.

An ARC file starts with a version block that names its fields; each record is a header line of
these fields, the last being the length of what follows. Version 1 has five fields, version 2
ten. The converter reads a record by its declared length and makes the WARC headers up from
it: identifier, date, type and digests. Blocks are bytes of any kind. A record with an HTTP head
is a response, a filedesc record a warcinfo, any other a resource of its ARC content type; the
version block that starts a file is read for its fields only. Archives are written by Spark's
text writer, so any store that Spark writes to will do: a file is one gzip member of bounded size.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.session import scratch_folder

#: Fixed by the formats: fields of ARC header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"),
}
#: Fixed by the format: the profile of revisit records.
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_KEY, _SIZE = "Archive-Key", "Archive-Payload-Length"
#: Bytes of blocks that a task hands on together.
FRAME_BYTES = 8 << 20
#: Bytes of records that are written as one value, and values in a file.
VALUE_BYTES, VALUES = 1 << 22, 32


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


def _no_space(text: str) -> str:
    return re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text) or "-"


def arc_file(version: int, name: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, 14-digit date, content type, block) records."""
    about = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = []
    for url, date, kind, block in [(f"filedesc://{name}", "20000101000000", "text/plain", about), *records]:
        given = {"URL": _no_space(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind,
                 "Result-code": "200", "Filename": name, "Archive-length": str(len(block))}
        out += [" ".join(given.get(f, "-") for f in ARC_FIELDS[version]).encode(), b"\n", block, b"\n"]
    return b"".join(out)


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block; a block that is cut short is an error."""
    at, version = 0, 0
    while at < len(raw):
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r")
        at = end + 1
        if not line.strip():
            continue
        if not version:  # the version block describes itself: its second part names the fields
            size = int(line.rsplit(" ", 1)[1])
            about = raw[at:at + size].decode("ascii", "replace")
            version = int(about.split(" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            at += size
            continue
        names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"an ARC header line has {len(values)} fields, not {len(names)}")
        fields = dict(zip(names, values, strict=True))
        size = int(fields["Archive-length"])
        if size < 0 or at + size > len(raw):
            raise ValueError("an ARC record is shorter than its header says")
        yield ArcRecord(version, fields, raw[at:at + size])
        at += size


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """An ARC date (14 digits, or fewer, filled up) as a WARC date."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00000101000000"[len(digits):]
    return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its empty line, and payload; a block without a head is all payload."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[:end + 4], block[end + 4:]
    return b"", block


def to_arc(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(key, arc): each page as an ARC file, of version 1 for even keys and 2 for others."""
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 256):
                part = f.iloc[i:i + 256]
                arcs = []
                for k, u, t in zip(part["key"], part["url"], part["text"], strict=True):
                    payload = t.encode()
                    number = 0 if pd.isna(k) else int(k)
                    date = datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=number % 2**30)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                    arcs.append(arc_file(1 + number % 2, f"{number}.arc", [
                        (u or "", date.strftime("%Y%m%d%H%M%S"), "text/html", head.encode() + payload)]))
                yield pd.DataFrame({"key": part["key"].astype("Int64"), "arc": arcs})
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(write, "key long, arc binary")


def type_of(uri: str, kind: str, head: bytes) -> tuple[str, str]:
    """WARC type and content type of an ARC record."""
    if head:
        return "response", "application/http; msgtype=response"
    known = kind if "/" in kind else "application/octet-stream"
    return ("warcinfo" if uri.startswith("filedesc:") else "resource"), known


_CONVERTED = ("key long, record_id string, uri string, date string, record_type string, content_type string, head binary, "
              "payload {kind}, payload_bytes long, payload_digest string, content_id string")


def convert(arcs: DataFrame, with_payload: bool = True, with_digest: bool = True, with_content_id: bool = True) -> DataFrame:
    """WARC facts of the records in (key, arc) rows, each an ARC file; several records share a key.

    record_id is made from key, place, address and date. content_id is a SHA-256 of the payload. A
    caller that needs no payload (then empty), digest or content_id (then null) spares their cost.
    """
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _CONVERTED.split(", ")]
        for f in frames:
            out, size = [], 0
            for k, arc in zip(f["key"], f["arc"], strict=True):
                for place, r in enumerate(parse_arc(arc)):
                    head, payload = split_http(r.block)
                    uri, date = r.fields["URL"], iso_date(r.fields["Archive-date"])
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{'' if pd.isna(k) else int(k)} {place} {date} {uri}")
                    out.append((k, f"<urn:uuid:{name}>", uri, date, *type_of(uri, r.fields["Content-type"], head), head,
                                payload if with_payload else b"", len(payload), digest(payload) if with_digest else None,
                                hashlib.sha256(payload).hexdigest() if with_content_id else None))
                    size += len(r.block) if with_payload else 0
                    if len(out) >= 1000 or size >= FRAME_BYTES:
                        yield pd.DataFrame(out, columns=names).astype({"key": "Int64"})
                        out, size = [], 0
            yield pd.DataFrame(out, columns=names).astype({"key": "Int64"})
    return arcs.mapInPandas(read, _CONVERTED.format(kind="binary"))


def first_of_equal(records: DataFrame, least: int = 0) -> DataFrame:
    """(key, record_id, refers_to): of equal payloads of `least` bytes or more, the largest key's
    record keeps it, others refer to its record_id and are revisits. refers_to is null for the rest.

    Rows with a null key are no revisits, nor are rows that share the largest key, nor warcinfos.
    """
    known = records.filter("key is not null and record_type <> 'warcinfo'").filter(F.col("payload_bytes") >= least).select(
        "key", "record_id", "content_id", "payload_bytes")
    best = known.groupBy("content_id", "payload_bytes").agg(
        F.max("key").alias("best"), F.max_by("record_id", F.struct("key", "record_id")).alias("target"))
    return known.join(best, ["content_id", "payload_bytes"]).filter("key < best").select(
        "key", "record_id", F.col("target").alias("refers_to")).distinct()


def write_warc(records: DataFrame, revisits: DataFrame, folder: str, value_bytes: int = VALUE_BYTES,
               level: str = "BEST_SPEED") -> None:
    """Writes WARC files, gzip-compressed, below `folder`: a revisit per row of revisits, else the record's own type.

    level is Hadoop's name of a compression level; the fastest costs about a tenth more bytes.
    A value holds records of up to value_bytes, or a single larger one, and a file VALUES values.
    """
    def encoded(r) -> bytes:
        revisit = r.refers_to is not None
        block = r.head + (b"" if revisit else r.payload)
        head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else r.record_type}",
                f"WARC-Record-ID: {r.record_id}", f"WARC-Date: {r.date}", f"WARC-Target-URI: {r.uri}",
                f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{r.payload_digest}",
                f"Content-Type: {r.content_type}", f"Content-Length: {len(block)}"]
        if r.record_type == "warcinfo":
            head[4] = f"WARC-Filename: {r.uri.removeprefix('filedesc://')}"
        if not pd.isna(r.key):
            head.append(f"{_KEY}: {int(r.key)}")
        if revisit:
            head += [f"WARC-Refers-To: {r.refers_to}", f"WARC-Profile: {REVISIT}", f"{_SIZE}: {int(r.payload_bytes)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            for i in range(0, len(f), 256):
                for r in f.iloc[i:i + 256].itertuples():
                    record = encoded(r)
                    if held and size + len(record) > value_bytes:
                        yield pd.DataFrame({"value": [b"\r\n\r\n".join(held)]})
                        held, size = [], 0
                    held.append(record)
                    size += len(record)
        if held:
            yield pd.DataFrame({"value": [b"\r\n\r\n".join(held)]})

    rows = records.join(revisits.hint("merge"), ["key", "record_id"], "left").select(
        "key", "record_id", "uri", "date", "record_type", "content_type", "head", "payload", "payload_bytes",
        "payload_digest", "refers_to")
    # the cast leaves bytes as they are, and so does the text writer
    values = rows.mapInPandas(encode, "value binary").select(F.col("value").cast("string"))
    values.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "zlib.compress.level", level).option("maxRecordsPerFile", VALUES).text(folder)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError("no WARC record where one should start")
        lines = raw[at:end].decode().split("\r\n")[1:]
        fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = raw[end + 4:end + 4 + size]
        at = end + 8 + size
        if len(block) < size or raw[at - 4:at] != b"\r\n\r\n":
            raise ValueError("a WARC record is shorter than its header says")
        yield fields, block


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True, checked: bool = True) -> DataFrame:
    """One row per record: key, record_id, record_type, uri, date, payload_bytes, payload_digest,
    refers_to_id and payload (null for revisits). Files hold any number of gzip members. Digests of
    blocks and payloads are checked where a record names SHA-1 ones, unless `checked` is false; a
    warcinfo has no uri. Without `with_payload` all payloads are null."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "record_id", "record_type", "uri", "date", "payload_bytes", "payload_digest", "refers_to_id", "payload"]
        for f in frames:
            for content in f["content"]:
                out = []
                for h, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(content)).read()):
                    head, payload = split_http(block)
                    whole, told = h.get("warc-block-digest", ""), h.get("warc-payload-digest", "")
                    revisit = h["warc-type"] == "revisit"
                    if checked and (whole.startswith("sha1:") and whole != f"sha1:{digest(block)}" or (
                            not revisit and told.startswith("sha1:") and told != f"sha1:{digest(payload)}")):
                        raise ValueError(f"record {h['warc-record-id']} does not have its digest")
                    size = re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M) if revisit else None
                    size = h.get(_SIZE.lower()) if _SIZE.lower() in h else size and size[1]
                    key = h.get(_KEY.lower())
                    out.append((None if key is None else int(key), h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"),
                                h["warc-date"], int(size) if size else len(payload),
                                told.removeprefix("sha1:") or None, h.get("warc-refers-to"),
                                None if revisit or not with_payload else payload))
                    if len(out) == (256 if with_payload else 2000):
                        yield pd.DataFrame(out, columns=names).astype({"key": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=names).astype({"key": "Int64"})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInPandas(read, "key long, record_id string, record_type string, uri string, date string, "
                             "payload_bytes long, payload_digest string, refers_to_id string, payload binary")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least: int = 0,
            with_payload: bool = True) -> DataFrame:
    """Pages through ARC into WARC archives below the checkpoint folder, and the records read back.

    Adds refers_to, the key of the response that a revisit names, to the columns of read_warc.
    Null texts are empty payloads, null addresses are "-", blanks in addresses are escaped. Rows
    with a null key are responses. Rows that repeat share their record's identifier and type. An
    empty table gives no rows. Other columns of pages are not read. Without `with_payload`
    payloads are read back and checked, and left out of the result.
    """
    spark = pages.sparkSession
    folder = scratch_folder(spark, "warc")
    arcs = to_arc(pages, key, url, text)
    write_warc(convert(arcs, with_content_id=False),
               first_of_equal(convert(arcs, with_payload=False, with_digest=False), least), folder)
    records = read_warc(spark, folder, with_payload)
    targets = read_warc(spark, folder, with_payload=False, checked=False).filter("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to")).distinct()
    return records.join(targets, "refers_to_id", "left")

