"""ARC files written, converted to WARC and read back; records of foreign ARC files."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from wayline.llm import web_archive
from wayline.llm.web_archive import ARC_FIELDS, Crawl, arc_records, converted, digest, iso_time, warc_records

KINDS = "page_id long, url string, html string"


@pytest.fixture()
def small_files(monkeypatch):
    monkeypatch.setattr(web_archive, "FILE_BYTES", 4000)


def through(spark, rows, tmp_path, kinds=KINDS, **more):
    pages = spark.createDataFrame(rows, kinds)
    arc = web_archive.write_arc(pages if not rows else pages.repartition(3), f"{tmp_path}/arc")
    return web_archive.convert(spark, arc, f"{tmp_path}/warc", **more)


def brute(rows, least=0):
    first = {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault((html or "").encode(), page_id)
    out, held = [], set()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        body = (html or "").encode()
        again = body in held and len(body) >= least
        held.add(body)
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), sha, "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def rows_of(rnd):
    bodies = ["", None, "<p>é中</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n\r\n", "http://x 0.0.0.0 20200101000000 text/html 5\nab", "<b>" + "x" * 9000, "\x00\n\x00", "Z" * 3000]
    rows = [(i, f"http://h/{i} a\tb", rnd.choice(bodies) if rnd.random() < 0.7 else f"page {rnd.random()}") for i in range(120)]
    return rows + [(500, None, "only"), (501, "", "only"), (502, "http://é/\n", "x" * 400_000), (503, "http://b/", "x" * 400_000), (None, "http://n/", "no id"), (504, "http://t/", "tie")] + [(505, "http://t/", "tie")] * 2


@pytest.mark.parametrize("least", [0, 10])
def test_pages_come_back(spark, tmp_path, small_files, least):
    rows = rows_of(random.Random(2))
    warc = through(spark, rows, tmp_path, least_bytes=least)
    assert found(web_archive.page_records(spark, warc)) == brute(rows, least)
    records = web_archive.read_warc(spark, warc, payloads=True).collect()
    assert all(r["intact"] for r in records)
    held = {r["record_id"]: r for r in records if r["record_type"] == "response"}
    bodies = {page_id: (html or "").encode() for page_id, _, html in rows}
    for r in records:
        source = held[r["refers_to_id"]] if r["record_type"] == "revisit" else r
        assert bytes(source["payload"]) == bodies[r["page_id"]] and source["payload_digest"] == r["payload_digest"]
    assert len({r["record_id"] for r in records}) == len(rows)


def test_files_are_whole_archives(spark, tmp_path, small_files):
    warc = through(spark, rows_of(random.Random(4)), tmp_path)
    versions = set()
    for kind in ("arc", "warc"):
        files = [p for p in Path(tmp_path, kind).glob("part-*") if p.stat().st_size]
        assert len(files) > 6
        for path in files:
            text = gzip.decompress(path.read_bytes())  # a member that breaks raises
            if kind == "arc":
                _, fields, _ = next(arc_records(path.read_bytes()))
                versions.add(fields["version"])
                assert text.startswith(b"filedesc://pages-")
            else:
                info = next(warc_records(path.read_bytes()))
                assert info.fields["warc-type"] == "warcinfo" and b"ARC version" in info.block
    assert versions == {"1", "2"}
    assert warc == f"{tmp_path}/warc"


def test_one_payload_on_most_pages(spark, tmp_path, small_files):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(600)]
    assert found(web_archive.page_records(spark, through(spark, rows, tmp_path))) == brute(rows)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    assert web_archive.page_records(spark, through(spark, [], tmp_path / "a")).collect() == []
    kinds = "name string, page_id long, url string, html string, content string, of int"
    rows = [("n", 4, "http://a/", "x", "c", 1), ("n", 3, "http://a/", "x", "c", 1)]
    assert found(web_archive.page_records(spark, through(spark, rows, tmp_path / "b", kinds))) == brute([r[1:4] for r in rows])


def foreign(version, records, origin="Alexa Internet"):
    body = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n"
    extra = "" if version == 1 else " 200 - - 0 x.arc"
    out = f"filedesc://x.arc 0.0.0.0 19960923142103 text/plain{extra} {len(body)}\n{body}\n".encode()
    for line, block in records:
        out += line.encode() + b"\n" + block + b"\n"
    return out


def test_records_of_both_versions():
    http = b"HTTP/1.0 200 OK\nContent-type: text/html\n\n<b>old</b>\n"
    first = foreign(1, [
        (f"http://a/with space/ 1.2.3.4 19970101120000 text/html {len(http)}", http),
        ("dns:a 1.2.3.4 199701011201 text/dns 4", b"addr"),
        ("ftp://a/f 1.2.3.4 bad application/zip 2", b"PK"),
    ])
    second = foreign(2, [(f"http://b/ 1.2.3.4 19980101120000 text/html 404 ABC - 77 x.arc {len(http)}", http)])
    info, page, dns, ftp = converted("x", first)
    assert info.kind == "warcinfo" and b"ARC version 1" in info.payload
    assert (page.kind, page.fields["WARC-Target-URI"], page.payload) == ("response", "http://a/with space/", b"<b>old</b>\n")
    assert page.fields["WARC-Date"] == "1997-01-01T12:00:00Z" and page.fields["WARC-Payload-Digest"] == f"sha1:{digest(page.payload)}"
    assert (dns.kind, dns.fields["Content-Type"], dns.payload, dns.fields["WARC-Date"]) == ("response", "text/dns", b"addr", "1997-01-01T12:01:00Z")
    assert (ftp.kind, ftp.fields["WARC-Date"]) == ("resource", "1996-09-23T14:21:03Z")
    info2, page2 = converted("y", gzip.compress(second))
    assert b"ARC version 2" in info2.payload and page2.payload == page.payload
    assert len({x.record_id for x in (info, page, dns, ftp, info2, page2)}) == 6
    assert [x.record_id for x in converted("x", first)] == [info.record_id, page.record_id, dns.record_id, ftp.record_id]


def test_broken_archives():
    whole = foreign(1, [("no header at all", b"x"), ("http://a/ 1.2.3.4 19970101120000 text/html 3", b"abc"), ("http://b/ 1.2.3.4 19970101120000 text/html 50", b"cut")])
    _, a, b = converted("x", whole)
    assert (a.payload, b.payload) == (b"abc", b"cut\n")
    assert list(arc_records(b"")) == []
    with pytest.raises(ValueError, match="not an ARC file"):
        list(arc_records(b"<html>\n"))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc_records(b"<html>\n"))


def test_times():
    assert iso_time("20240229235959") == "2024-02-29T23:59:59Z"
    assert iso_time("20240229235959123") == "2024-02-29T23:59:59Z"
    for odd in ("", "0", "20249999999999", "2024-01-01"):
        assert iso_time(odd) == "1970-01-01T00:00:00Z"
    assert iso_time("x", Crawl().date) == "20260101000000"
