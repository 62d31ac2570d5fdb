import base64
import gzip
import hashlib
import random
import zlib
from html.parser import HTMLParser

from quarry.llm import warc

SF = "/root/testdata/sf0.001"
BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden.append(tag)
        if not self.hidden:
            self.out.append("\n" if tag in BLOCKS else "")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
            self.out.append(" ")
        elif not self.hidden:
            self.out.append("\n" if tag in BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.replace("\n", " "))

    def text(self):
        lines = "".join(self.out).replace("\xa0", " ").split("\n")
        return "\n".join(x for x in (" ".join(y.split()) for y in lines) if x)


def test_derivatives_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: r for r in pages.collect()}
    got = warc.derivatives(warc.page_responses(pages, ["page_id", "url"]), ["page_id", "url"]).collect()
    assert len(got) == len(want)
    for r in got:
        parser = Visible()
        parser.feed(want[r.page_id].html)
        assert r.text == parser.text() and r.n_chars == len(r.text)
        meta, end = warc.parse_at(bytes(r.metadata))
        conv, conv_end = warc.parse_at(bytes(r.conversion))
        assert end == len(r.metadata) and conv_end == len(r.conversion)
        assert meta.get("WARC-Refers-To") == conv.get("WARC-Refers-To") == r.response_id
        assert meta.get("WARC-Concurrent-To") == r.conversion_id == conv.get("WARC-Record-ID")
        assert conv.get("WARC-Target-URI") == want[r.page_id].url and conv.get("WARC-Date") == warc.PAGE_DATE
        assert conv.block.decode() == r.text
        body = want[r.page_id].html.encode()
        sha = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert f"source-payload-digest: {sha}\r\n" in meta.block.decode() and conv.get("warc-source-payload-digest") == sha
        assert "source-status: HTTP/1.1 200 OK\r\nsource-header-content-type: text/html; charset=utf-8\r\n" in meta.block.decode()


def test_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(30)
    records = warc.page_responses(pages, ["page_id"])
    warc.write_warc(records, "record", str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(bytes(r.record) for r in back) == sorted(bytes(r.record) for r in records.collect())


def test_broken_null_and_repeated(spark):
    good = warc.response_record("k", None, "<p>a&nbsp;b<br>c")
    rows = [(1, good), (1, good), (2, None), (3, b"junk"), (4, good[:-30]), (None, warc.serialize([("WARC-Type", "request")], b""))]
    frame = spark.createDataFrame([(i, None if x is None else bytearray(x), "z") for i, x in rows], "id long, record binary, text string")
    got = warc.derivatives(frame, ["id", "text"]).collect()
    assert [r.error is None for r in got] == [True, True, False, False, False, False]
    assert got[0] == got[1] and got[0].text == "a b\nc" and got[0].target_uri is None
    assert warc.derivatives(frame.limit(0), ["id"]).count() == 0
    empty = warc.page_responses(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string"), ["page_id"])
    assert warc.derivatives(empty, ["page_id"]).first().text == ""


def response(http, body, **more):
    head = "".join(f"{k}: {v}\r\n" for k, v in http)
    block = f"HTTP/1.1 200 OK\r\n{head}\r\n".encode() + body
    return warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{hashlib.sha1(block).hexdigest()}>"), *more.items()], block)


def chunks(body, size):
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(f"{len(p):X};x=1\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"


PAGE = "<html><body><p>Caf\u00e9 \u2013 na\u00efve</p></body></html>"
SAYS = "Caf\u00e9 \u2013 na\u00efve"


def test_codings_charsets_and_media_types(spark):
    gz = gzip.compress(PAGE.encode())
    kind = ("Content-Type", "text/html; charset=utf-8")
    cases = [
        ([kind], PAGE.encode(), SAYS), ([kind, ("Content-Encoding", "gzip")], gz, SAYS), ([kind, ("Content-Encoding", "gzip")], PAGE.encode(), SAYS),
        ([kind, ("Content-Encoding", "deflate")], zlib.compress(PAGE.encode()), SAYS),
        ([kind, ("Content-Encoding", "deflate")], zlib.compress(PAGE.encode())[2:-4], SAYS),
        ([kind, ("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")], chunks(gz, 7), SAYS),
        ([("content-type", "text/html; charset=ISO-8859-1")], PAGE.encode("cp1252"), SAYS),
        ([("Content-Type", "text/html")], b'<meta charset="windows-1252">' + PAGE.encode("cp1252"), SAYS),
        ([("Content-Type", "text/html")], PAGE.encode("utf-16"), SAYS), ([("Content-Type", "text/html; charset=base64")], PAGE.encode(), SAYS),
        ([], PAGE.encode(), SAYS), ([("Content-Type", "text/plain")], b" a <b>\r\nc ", "a <b>\nc"), ([kind], b"", ""),
        ([("Content-Type", "image/png")], b"\x89PNG\r\n\x1a\n\0\xff", None), ([kind, ("Content-Encoding", "br")], b"\x0b\x02", None),
        ([kind, ("Content-Encoding", "gzip")], gz[:-20] + b"junk" * 9, None), ([], b"\0\1\2", None),
    ]
    frame = spark.createDataFrame([(i, bytearray(response(h, b))) for i, (h, b, _) in enumerate(cases)], "id long, record binary")
    for r in warc.derivatives(frame, ["id"]).collect():
        want = cases[r.id][2]
        assert r.text == want and (r.error is None) == (want is not None), (r.id, r.text, r.error)
        meta, _ = warc.parse_at(bytes(r.metadata))
        assert (r.conversion is None) == (r.conversion_id is None) == (meta.get("WARC-Concurrent-To") is None) == (want is None)
        assert r.payload_digest == warc.digest(cases[r.id][1])


def test_a_body_that_inflates_beyond_the_bound_is_an_error(monkeypatch):
    monkeypatch.setattr(warc, "MAX_BODY", 1000)
    body = gzip.compress(b"<p>" + b"a" * 5000)
    *_, conversion, text, why = warc.derive(response([("Content-Type", "text/html"), ("Content-Encoding", "gzip")], body))
    assert conversion is None and text is None and "1000 bytes" in why


def test_any_bytes_round_trip_in_members_of_their_own(spark, tmp_path):
    rng = random.Random(3)
    bodies = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 300, 70_000)] + [b"\0\n\r\x1f\x8b" * 50, b"z" * (1 << 24), "na\u00efve".encode("latin-1")]
    records = [response([("Content-Type", "image/png")], b) for b in bodies]
    frame = spark.createDataFrame([(bytearray(r),) for r in records] + [(None,)], "record binary").coalesce(1)
    warc.write_warc(frame, "record", str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(bytes(r.record) for r in back) == sorted(records) and all(r.error is None for r in back)
    (file,) = (tmp_path / "w").glob("part-*")
    data, members = file.read_bytes(), []
    while data:
        unzip = zlib.decompressobj(31)
        members.append(unzip.decompress(data))
        data = unzip.unused_data
    assert sorted(m for m in members if m) == sorted(records)
    whole = gzip.compress(b"".join(records))
    for data in (whole, b"".join(records)):
        assert [r for r, _ in warc.records_of(data)] == records
    assert [e is None for _, e in warc.records_of(whole[:-200])][-1] is False and list(warc.records_of(b"junk and more"))[0][1]


def test_very_long_page(spark):
    page = "<p>word</p>" * 300_000
    got = warc.derivatives(warc.page_responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), ["page_id"]), ["page_id"]).first()
    assert got.n_chars == 5 * 300_000 - 1
