"""Legacy crawl archives (ARC) converted to WARC, with revisits for payloads that occur again.

An ARC file begins with a version block, whose second line names the version and whose third the
fields of all header lines: five in version 1, ten in version 2. After it, records are a header
line and as many bytes as its last field declares; no other mark bounds them, so texts may hold
anything. The converter reads header lines by the block's field list, from the right (old URLs hold
spaces), and makes of each record what WARC wants and ARC lacks: a record id (a UUID of archive
name and record number), an ISO time, a type (`warcinfo` for the version block, `response` for
what a server sent, `resource` for the rest), SHA-1 digests of block and payload. Of records with
equal payloads one is the response, the others become `revisit` records that hold their own HTTP
head and name the response.

On Spark: archives are files of about FILE_BYTES of text, one gzip member a record. A task makes
whole files and Spark's text writer commits them, one row a file, so a lost task leaves nothing
half written, on any file system. (A text row ends with a separator: the last byte of a gzip
member without content is zero, and so is the separator.) A first reading of the ARC files gives
digests, 100 bytes or so a record; the response of each payload is an aggregate; then the ARC files
join the lists of their own revisits, by file, and are read again to be written as WARC. Payloads
are never shuffled apart from their archive.

Defined results: a null html is an empty payload; a null or empty url is `about:blank`, and control
characters and spaces of a url are written as %XX; a null page id is no header, and comes behind
others; repeated rows are records each, the first by (page id, time, file, place) being the
response; payloads below `least_bytes` are all responses; an archive line that is no header is
passed over up to the next that is; a block cut short by the end of its file keeps what is there;
a page of any size is one record, in memory once or twice while it is written or read (a longer
page than FILE_BYTES is a file of its own); no pages give no files and no rows. Only the named
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.tables import arrow_schema, as_table, pick
from wayline.session import materialize

#: Text of an archive, about.
FILE_BYTES = 16 << 20
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ID_HEADER = "X-Page-Id"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What ends a file; see above.
_LAST = gzip.compress(b"", mtime=0)


@dataclass(frozen=True)
class Crawl:
    """What the pages table doesn't say about its crawl."""

    date: str = "20260101000000"
    ip: str = "0.0.0.0"
    origin: str = "crawl"
    versions: tuple[int, ...] = (1, 2)  # of the archives, in turn
    level: int = 1  # of compression


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _stream(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


# ARC


def _url(url: str | None) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode()) or b"about:blank"


def _version_block(name: str, version: int, crawl: Crawl) -> bytes:
    body = f"{version} 0 {crawl.origin}\n{' '.join(ARC_FIELDS[version])}\n"
    values = [f"filedesc://{name}", "0.0.0.0", crawl.date, "text/plain"]
    values += {1: [], 2: ["200", "-", "-", "0", name]}[version]
    return f"{' '.join(values)} {len(body)}\n{body}\n".encode()


def _arc_record(page_id, url: str | None, html: str | None, version: int, name: str, offset: int, crawl: Crawl) -> bytes:
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n"
    if page_id is not None:
        head += f"{ID_HEADER}: {page_id}\r\n"
    block = head.encode() + b"\r\n" + payload
    values = [_url(url), crawl.ip.encode(), crawl.date.encode(), b"text/html"]
    if version == 2:
        values += [b"200", digest(payload).encode(), b"-", str(offset).encode(), name.encode()]
    return b" ".join([*values, str(len(block)).encode()]) + b"\n" + block + b"\n"


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Number, header fields (names in lower case) and block of each record; number 0 is the version block."""
    stream = _stream(content)
    names, at = [n.lower() for n in ARC_FIELDS[1]], 0
    for line in iter(stream.readline, b""):
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").rstrip(" ")
        if at == 0 and not values.startswith("filedesc://"):
            raise ValueError(f"not an ARC file: {values[:60]!r}")
        if at:
            values = values.rsplit(" ", len(names) - 1)
        else:  # its own line has the fields of its version: the length is last in all
            parts = values.split(" ")
            dates = [x for x in parts if re.fullmatch(r"\d{12,17}", x)]
            values = [parts[0], "0.0.0.0", dates[0] if dates else "", "text/plain", parts[-1]]
        if len(values) != len(names) or not values[-1].isdecimal():
            continue
        block = stream.read(int(values[-1]))
        fields = dict(zip(names, values))
        if at == 0:
            version, definition, *_ = [*block.decode("utf-8", "replace").splitlines(), "", ""]
            fields["version"] = version.split(" ")[0]
            names = definition.lower().split() or [n.lower() for n in ARC_FIELDS[2 if fields["version"] == "2" else 1]]
        yield at, fields, block
        at += 1


def _files(each: Iterator[tuple[bytes, bytes | None]], level: int) -> Iterator[bytes]:
    """Archives of records; a record may come with what a file begins with, and begins one then."""
    members, size = [], 0
    for record, first in each:
        if first is not None and members:
            yield b"".join([*members, _LAST])
            members, size = [], 0
        members += [gzip.compress(x, level, mtime=0) for x in (first, record) if x]
        size += len(record)
    if members:
        yield b"".join([*members, _LAST])


def _write_files(contents: DataFrame, path: str) -> str:
    """Rows of `content` as files that end with a zero byte."""
    whole = F.substring("content", F.lit(1), F.octet_length("content") - 1)
    contents.select(whole.cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def _contents(files: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for content in files:
        yield pa.record_batch([pa.array([content], pa.binary())], ["content"])


def write_arc(pages: DataFrame, path: str, crawl: Crawl = Crawl(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Pages as ARC files below the path, in the order they are read."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes | None]]:
        number = size = 0
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, html = (batch.column(c)[i].as_py() for c in range(3))
                first = None
                if size == 0 or size >= FILE_BYTES:
                    version = crawl.versions[number % len(crawl.versions)]
                    name = f"pages-{number:06d}.arc.gz"
                    first = _version_block(name, version, crawl)
                    number, size = number + 1, len(first)
                record = _arc_record(page_id, url, html, version, name, size, crawl)
                size += len(record)
                yield record, first

    return _write_files(rows.mapInArrow(lambda batches: _contents(_files(records(batches), crawl.level)), "content binary"), path)


# ARC to WARC


@dataclass
class Converted:
    """A record as WARC: its header fields, and block = head + payload."""

    kind: str
    record_id: str
    fields: dict[str, str]
    head: bytes
    payload: bytes
    page_id: str | None = None

    def serialised(self) -> bytes:
        block = self.head + self.payload
        lines = {"WARC-Type": self.kind, "WARC-Record-ID": f"<urn:uuid:{self.record_id}>", **self.fields}
        lines |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
        text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
        return text.encode() + block + b"\r\n\r\n"


def iso_time(digits: str, otherwise: str = "1970-01-01T00:00:00Z") -> str:
    """The time of an archive date: 14 digits, or 12 without seconds; more are cut off."""
    for n, form in ((14, "%Y%m%d%H%M%S"), (12, "%Y%m%d%H%M")):
        if len(digits) >= n and digits.isdecimal():
            try:
                return datetime.strptime(digits[:n], form).strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                continue
    return otherwise


def _head_and_payload(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP block at the empty line after its head; one without such a line is all head."""
    ends = [i + len(x) for x in (b"\r\n\r\n", b"\n\n") if (i := block.find(x)) >= 0]
    end = min(ends, default=len(block))
    return block[:end], block[end:]


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb"[ \t]*:[ \t]*(.*?)[ \t]*\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def converted(name: str, content: bytes) -> Iterator[Converted]:
    """The records of an ARC file as WARC records, none a revisit yet."""
    info_id, begun = "", "1970-01-01T00:00:00Z"
    for at, fields, block in arc_records(content):
        record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"arc:{name}#{at}"))
        if at == 0:
            info_id, begun = record_id, iso_time(fields["archive-date"], begun)
            body = f"software: wayline\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {fields['version']}\r\n"
            yield Converted("warcinfo", record_id, {"WARC-Date": begun, "WARC-Filename": f"{name}.warc.gz", "Content-Type": "application/warc-fields"}, b"", body.encode())
            continue
        url = fields["url"]
        scheme = urlsplit(url).scheme.lower() if ":" in url else ""
        web = block.startswith(b"HTTP/")
        head, payload = _head_and_payload(block) if web else (b"", block)
        common = {
            "WARC-Date": iso_time(fields.get("archive-date", ""), begun),
            "WARC-Target-URI": url,
            "WARC-IP-Address": fields.get("ip-address", "0.0.0.0"),
            "WARC-Warcinfo-ID": f"<urn:uuid:{info_id}>",
            "WARC-Payload-Digest": f"sha1:{digest(payload)}",
            "Content-Type": "application/http; msgtype=response" if web else fields.get("content-type", "application/octet-stream"),
        }
        yield Converted("response" if web or scheme == "dns" else "resource", record_id, common, head, payload, _header(head, ID_HEADER))


def revisit(record: Converted, of: dict) -> Converted:
    """The record without its payload, which the other one holds."""
    fields = {
        **record.fields,
        "WARC-Profile": REVISIT,
        "WARC-Refers-To": f"<urn:uuid:{of['record_id']}>",
        "WARC-Refers-To-Target-URI": of["url"],
        "WARC-Refers-To-Date": of["date"],
    }
    return Converted("revisit", record.record_id, fields, record.head, b"", record.page_id)


def _read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def convert(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0, level: int = 6) -> str:
    """The ARC files below a path as WARC files below another, one for one."""
    sent = arrow_schema(kinds := "name string, record_id string, page_id string, url string, date string, digest string, n_bytes long")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                found = [
                    (name.as_py(), x.record_id, x.page_id, x.fields["WARC-Target-URI"], x.fields["WARC-Date"], x.fields["WARC-Payload-Digest"], len(x.payload))
                    for x in converted(name.as_py(), content.as_py())
                    if x.kind == "response"
                ]
                yield from as_table(dict(zip(sent.names, zip(*found) if found else [[]] * len(sent))), sent).to_batches()

    files = _read(spark, arc)
    responses = materialize(files.mapInArrow(keys, kinds), "responses").where(F.col("n_bytes") >= least_bytes)
    page = F.col("page_id").try_cast("long")
    # equal digests and lengths are equal payloads; the smallest page id first, records without one last
    order = F.struct(page.isNull(), page, "page_id", "date", "name", "record_id")
    first = F.min_by(F.struct("record_id", "url", "date"), order).alias("of")
    firsts = responses.groupBy("digest", "n_bytes").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
    again = responses.select("name", "record_id", "digest", "n_bytes").join(firsts, ["digest", "n_bytes"]).where("record_id <> of.record_id")
    # a file has so many records only; its list goes where the file is read
    lists = materialize(again.groupBy("name").agg(F.collect_list(F.struct("record_id", "of")).alias("revisits")), "revisits")
    joined = files.join(lists, "name", "left").select("name", "content", "revisits")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes | None]]:
        for batch in batches:
            for i in range(len(batch)):
                name, of = batch.column(0)[i].as_py(), {x["record_id"]: x["of"] for x in batch.column(2)[i].as_py() or []}
                for x in converted(name, batch.column(1)[i].as_py()):
                    text = (revisit(x, of[x.record_id]) if x.record_id in of else x).serialised()
                    yield (b"", text) if x.kind == "warcinfo" else (text, None)

    return _write_files(joined.mapInArrow(lambda batches: _contents(_files(records(batches), level)), "content binary"), warc)


# WARC


@dataclass
class Record:
    fields: dict[str, str] = field(default_factory=dict)  # names in lower case
    block: bytes = b""


def warc_records(content: bytes) -> Iterator[Record]:
    """The records of a WARC file, bounded by their declared lengths."""
    stream = _stream(content)
    for line in iter(stream.readline, b""):
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        record, name = Record(), ""
        for line in iter(stream.readline, b""):
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if not text:
                break
            if text[0] in " \t":  # a value goes on
                record.fields[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                record.fields[name] = value.strip()
        record.block = stream.read(int(record.fields["content-length"]))
        yield record


def _bare(text: str | None) -> str | None:
    return text.removeprefix("<urn:uuid:").removesuffix(">") if text else None


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records but warcinfo: record_id, record_type, page_id, url, date, payload_bytes, payload_digest, refers_to_id.

    payload_bytes and payload_digest are measured, for a revisit the first is null and the second
    as declared; `intact` tells whether the digests agree with those declared. `payloads` adds
    their bytes, null for a revisit.
    """
    kinds = "record_id string, record_type string, page_id long, url string, date string, payload_bytes long, payload_digest string, refers_to_id string, intact boolean"
    kinds += ", payload binary" if payloads else ""
    sent = arrow_schema(kinds)

    def row(record: Record) -> tuple:
        fields, kind = record.fields, record.fields["warc-type"]
        web = fields.get("content-type", "").startswith("application/http")
        head, payload = _head_and_payload(record.block) if web else (b"", record.block)
        declared = (fields.get("warc-payload-digest") or "").removeprefix("sha1:")
        measured = declared if kind == "revisit" else digest(payload)
        intact = measured == declared and fields.get("warc-block-digest") == f"sha1:{digest(record.block)}"
        page_id = _header(head, ID_HEADER)
        page_id = int(page_id) if page_id and re.fullmatch(r"-?\d{1,18}|-?\d{19}", page_id) else None
        out = (_bare(fields["warc-record-id"]), kind, page_id, fields.get("warc-target-uri"), fields.get("warc-date"))
        out += (None if kind == "revisit" else len(payload), measured, _bare(fields.get("warc-refers-to")), intact)
        return out + ((None if kind == "revisit" else payload,) if payloads else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows, size = [], 0
                for record in warc_records(content.as_py()):
                    if record.fields["warc-type"] != "warcinfo":
                        rows.append(row(record))
                        size += len(record.block) if payloads else 0
                    if size >= FILE_BYTES:
                        yield from as_table(dict(zip(sent.names, zip(*rows))), sent).to_batches()
                        rows, size = [], 0
                if rows:
                    yield from as_table(dict(zip(sent.names, zip(*rows))), sent).to_batches()

    return _read(spark, path).mapInArrow(run, kinds)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page in WARC files.

    What a revisit leaves out comes from the record it names: a join on that record's id, which is
    unique on its side, so many revisits of one record make no pairs.
    """
    records = materialize(read_warc(spark, path), "records")
    held = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("held_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("held_bytes")
    )
    joined = records.join(held, records["refers_to_id"] == held["held_id"], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
