"""Derived records, their links and digests, and round trips through WARC files."""

import base64
import gzip
import hashlib
import zlib

import pytest
import zstandard

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetmeter.llm import queries, warc


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_given_table(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.queries()["op3_warc_derivatives"](spark, sf).collect()
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    for i, page in pages.items():
        meta, text = by[i, "metadata"], by[i, "conversion"]
        assert meta["refers_to"] == text["refers_to"] and meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
        body = page["html"].encode()
        for r in (meta, text):
            assert r["target_uri"] == page["url"] and r["source_payload_digest"] == sha(body)
            assert r["source_block_digest"] == sha(r["source_head"].encode() + body)
            assert r["block_digest"] == sha(r["block"].encode())
            assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["warc_header"]
            assert f"Content-Length: {len(r['block'].encode())}\r\n\r\n" in r["warc_header"]
        assert f"payload-digest: {sha(body)}\r\n" in meta["block"] and "http-status: HTTP/1.1 200 OK\r\n" in meta["block"]
        assert "<" not in warc.TAGS.sub("<", text["block"]) and "track(" not in text["block"]


def test_text_and_links():
    page = (
        "<!DOCTYPE html><html lang=de><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script><body><!-- <p>no</p> -->"
        "<p>One <b>two</b>\n&lt;three&gt;<br>four</p><a href='/x?a=1&amp;b=2'>link</a><a href=\"/y\">y</a><a href=z>z</a><p>1 < 2"
    )
    made = {r["record_type"]: r for r in warc.derive("<urn:x>", "http://h/", None, "HTTP/1.1 404 Gone\r\nServer: s\r\n\r\n", page.encode())}
    assert made["conversion"]["block"] == "A & B\nOne two\n<three>\nfour\nlinkyz\n1 < 2"
    lines = made["metadata"]["block"].split("\r\n")
    assert [x for x in lines if x.startswith("outlink")] == ["outlink: /x?a=1&b=2", "outlink: /y", "outlink: z"]
    assert {"http-status: HTTP/1.1 404 Gone", "source-header: Server: s", "title: A & B", "language: de"} <= set(lines)


def test_charsets_and_broken_markup():
    latin = warc.derive("<urn:x>", None, None, "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n", "ä".encode("latin-1"))
    assert latin[1]["block"] == "ä"
    assert warc.derive("<urn:x>", None, None, "X\r\nContent-Type: a; charset=nosuch\r\n\r\n", b"a\xff")[1]["block"] == "a�"
    for page in ("<", "<<<<" * 50_000, "<!--" * 50_000, "<script>" * 20_000, "<a href=" * 50_000, "&#xD800; &#0;"):
        assert isinstance(warc.derive("<urn:x>", None, None, None, page.encode())[1]["block"], str)


def test_awkward_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a/", ""), (2, "http://a/", "<p>" + "long " * 100_000), (3, "http://b/\r\nX: y", "t")]
    pages = spark.createDataFrame([(*r, "rid", "kind") for r in rows], "page_id long, url string, html string, record_id string, record_type string")
    out = warc.derivatives(warc.responses(pages)).collect()
    assert len(out) == 2 * len(rows)
    assert len({r["record_id"] for r in out}) == 2 * 4  # equal rows are equal records
    assert all("\r\nX: y" not in r["warc_header"] for r in out)
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>ä {i}</p>\r\n\r\nWARC/1.1") for i in range(5)], "page_id long, url string, html string")
    found = warc.responses(pages, date="2024-05-06T07:08:09Z")
    for packed in (True, False):
        whole = b""
        for r in found.collect():
            block = r["http_head"].encode() + bytes(r["payload"])
            fields = [("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"])]
            record = warc.header("response", fields, len(block)).encode() + block + b"\r\n\r\n"
            info = warc.header("warcinfo", [], 0).encode() + b"\r\n\r\n"
            whole += b"".join(map(warc._gzip, (info, record))) if packed else info + record
        path = tmp_path / f"{packed}.warc"
        path.write_bytes(whole + (b"" if packed else b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ncut off"))
        got = warc.read(spark, str(path))
        names = ["record_id", "target_uri", "date", "http_head", "payload"]
        assert sorted(map(str, got.select(names).collect())) == sorted(map(str, found.select(names).collect()))
        one, two = (sorted((r["record_id"], r["block"]) for r in warc.derivatives(x).collect()) for x in (got, found))
        assert one == two
    made = warc.serialized(warc.derivatives(found))
    parsed = [p for r in made.collect() for p in warc.parse(bytes(r["warc"]))]
    assert sorted((f["warc-record-id"], b.decode()) for f, b in parsed) == sorted((r["record_id"], r["block"]) for r in made.collect())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>ap/!-\"'= \n&;", max_size=60))
def test_text_never_has_scripts_or_fails(page):
    text = warc.plain_text(page)
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


PAGE = "<title>T</title><p>hello wörld</p>" * 40


def chunked(data, size=7):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;x=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: t\r\n\r\n"


def bare(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


WHOLE = PAGE.encode()
ENCODED = {
    "Transfer-Encoding: chunked": chunked(WHOLE),
    "Content-Encoding: gzip": gzip.compress(WHOLE),
    "Content-Encoding: x-gzip\r\nTransfer-Encoding: chunked": chunked(gzip.compress(WHOLE)),
    "content-encoding:GZIP\r\nX: y": gzip.compress(WHOLE[:300]) + gzip.compress(WHOLE[300:]),
    "Content-Encoding: deflate": zlib.compress(WHOLE),
    "Content-Encoding: Deflate": bare(WHOLE),
    "Content-Encoding: zstd": zstandard.compress(WHOLE),
    "Content-Encoding: ZSTD": zstandard.compress(WHOLE[:300]) + zstandard.compress(WHOLE[300:]),
    "Content-Encoding: deflate, gzip": gzip.compress(zlib.compress(WHOLE)),
    "Content-Encoding: identity": WHOLE,
    # unpacked by the archiver, the header left
    "Content-Encoding: gzip\r\nTransfer-Encoding: chunked": WHOLE,
    "Content-Encoding: br": WHOLE,
    "no colon here": WHOLE,
}


@pytest.mark.parametrize("field", ENCODED)
def test_encodings_are_undone(field):
    head, payload = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{field}\r\n\r\n", ENCODED[field]
    meta, text = warc.derive("<urn:x>", "http://h/", None, head, payload)
    assert text["block"] == warc.plain_text(PAGE) and "title: T\r\n" in meta["block"] and "content-problem" not in meta["block"]
    assert text["source_payload_digest"] == sha(payload)  # of the bytes as archived
    assert text["source_block_digest"] == sha(head.encode() + payload)


def test_what_cannot_be_undone_is_said():
    def problem(field, payload):
        meta, text = warc.derive("<urn:x>", None, None, f"HTTP/1.1 200 OK\r\n{field}\r\n\r\n", payload)
        return [x[17:] for x in meta["block"].split("\r\n") if x.startswith("content-problem: ")], text["block"]

    packed = gzip.compress(b"<p>" + bytes(range(32, 127)) * 50)
    said, text = problem("Content-Encoding: gzip", packed[:-12])
    assert said == ["deflate: cut off"] and text.startswith("!")
    assert problem("Content-Encoding: gzip", packed[:-8] + b"12345678")[0] == ["deflate: damaged"]
    assert problem("Transfer-Encoding: chunked", b"5\r\nhello\r\n9\r\nwor") == (["chunked: cut off"], "hellowor")
    assert problem("Transfer-Encoding: chunked", b"5\r\nhello\r\nzz\r\n") == (["chunked: not a size"], "hello")
    assert problem("Content-Encoding: br", b"\x0b\x02\x80") == (["br: unknown coding"], "")
    assert problem("Content-Encoding: zstd", zstandard.compress(b"abc")[:-2])[0] == ["zstd: cut off"]
    assert problem("Content-Encoding: zstd", zstandard.compress(b"abc")[:4] + b"\xff" * 20)[0] == ["zstd: damaged"]
    assert problem("Content-Encoding: gzip", b"") == ([], "")


def records(n=5):
    out = []
    for i in range(n):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + f"<p>page {i}</p>".encode() * 50
        out.append(warc.header("response", [("WARC-Record-ID", f"<urn:{i}>")], len(block)).encode() + block + b"\r\n\r\n")
    return out


def ids(data):
    return [f["warc-record-id"][5:-1] for f, _ in warc.parse(data)], [(at, p) for at, f, _, p in warc.scan(data) if f is None]


@pytest.mark.parametrize("n", range(5))
def test_a_damaged_member_costs_its_own_record_only(n):
    members = [warc._gzip(r) for r in records()]
    start = sum(map(len, members[:n]))
    left = [str(i) for i in range(5) if i != n]
    middle = len(members[n]) // 2
    for bad in (
        members[n][:middle] + b"\xff" * 9 + members[n][middle + 9 :], members[n][:middle], members[n][:-6] + b"\0" * 6,
        b"\x1f\x8b\x08" + b"\xff" * 40,
    ):
        assert ids(b"".join([*members[:n], bad, *members[n + 1 :]])) == (left, [(start, "damaged member")])


@pytest.mark.parametrize("n", range(5))
def test_a_malformed_record_costs_itself_only(n):
    whole = records()
    start, left = sum(map(len, whole[:n])), [str(i) for i in range(5) if i != n]
    for length in (b"many", b"-1", b"", "²".encode()):
        bad = whole[n].replace(b"Content-Length: 669", b"Content-Length: " + length)
        assert bad != whole[n]
        assert ids(b"".join([*whole[:n], bad, *whole[n + 1 :]])) == (left, [(start, "no valid Content-Length")])
        packed = [warc._gzip(r) for r in [*whole[:n], bad, *whole[n + 1 :]]]
        assert ids(b"".join(packed)) == (left, [(sum(map(len, packed[:n])), "no valid Content-Length")])
    got, problems = ids(b"".join([*whole[:n], b"rubbish\r\n\r\n", *whole[n:]]))
    assert got == list("01234") and problems == [(start, "no record")]


def test_damages_are_rows(spark, tmp_path):
    whole = records(3)
    members = [warc._gzip(r) for r in whole]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + members[1][:-9] + members[2])
    (tmp_path / "b.warc").write_bytes(b"".join(whole)[:-100])
    (tmp_path / "c.warc").write_bytes(b"")
    found = sorted((r["path"][-9:].split("/")[-1], r["offset"], r["problem"]) for r in warc.damages(spark, str(tmp_path)).collect())
    assert found == [("a.warc.gz", len(members[0]), "damaged member"), ("b.warc", len(whole[0] + whole[1]), "record cut off")]
    assert warc.read(spark, str(tmp_path)).count() == 4
