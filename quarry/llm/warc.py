"""WARC derivatives: metadata and plain-text conversion records, made from response records.

A response record (its bytes in a binary column) gives two records that refer to it: `metadata`, with the source's
status, headers and digests as fields, and `conversion`, with the page's plain text. Both keep the target address and
the date of the response, state the response's identifier in WARC-Refers-To and name each other in
WARC-Concurrent-To. Identifiers are derived from the response's, so a repeated run gives the same records.

A response's body is taken from its transfer and content codings and read in its charset. A body that isn't text, or
is coded in a way that can't be undone, gives a metadata record only.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import itertools
import re
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quarry.llm.common import table

VERSION, CRLF = "WARC/1.1", "\r\n"
#: Capture date of pages, which have none of their own.
PAGE_DATE = "2024-01-01T00:00:00Z"
HTML, PLAIN = ("text/html", "application/xhtml+xml"), "text/plain"
#: Bytes that a body may have without its codings: what a cell of a column holds. A larger one is an error, not cut.
MAX_BODY = (1 << 31) - 1
BLOCK = 1 << 20
#: A body's type, where none is stated, follows from so many first bytes, and its meta element's charset from so many;
#: both are the numbers that the standards of MIME sniffing and HTML give.
SNIFFED, PRESCANNED = 1445, 1024
_MARKUP = re.compile(rb"[\t\n\f\r ]*<(?:!doctype html|html|head|script|iframe|h1|div|font|table|a|style|title|b|body|br|p|meta|!--|\?xml)", re.I)
_BINARY = re.compile(rb"[\0-\x08\x0b\x0e-\x1a\x1c-\x1f]")
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
#: Elements that may stand in a head, and those of them whose text is the head's.
_IN_HEAD, _HEAD_TEXT = frozenset(("meta", "link", "base", "title", *_HIDDEN)), frozenset(("title", *_HIDDEN))
_BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
# A tag to its end; a ">" in a quoted value doesn't end it. The alternatives exclude each other, so a scan is linear.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)(?:(?>[^>"'=]+)|=\s*(?>"[^"]*"|'[^']*')|=(?!\s*["'])|["'])*>""")
_SPACES, _LINES = re.compile(r"[ \t\r\f\v\u00a0]+"), re.compile(r" ?\n[ \n]*")


class WarcError(ValueError):
    """The bytes are not a whole record."""


class NoText(ValueError):
    """The response has no text to convert."""


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        """The first header of this name, whatever its case."""
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def serialize(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A whole record; headers without a value are left out, length and block digest are added."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None)]
    lines += [f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return (CRLF.join(lines) + CRLF * 2).encode() + block + (CRLF * 2).encode()


def parse_at(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at a place and the place after it. Raises WarcError if it isn't whole."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(b"WARC/", at):
        raise WarcError(f"no record at byte {at}")
    headers: list[tuple[str, str]] = []
    for line in bytes(data[at:end]).decode("utf-8", "replace").split(CRLF)[1:]:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no header: {line[:60]}")
        headers.append((name.strip(), value.strip()))
    record = Record(headers, b"")
    length = record.get("Content-Length") or ""
    start = end + 4
    if not length.isdigit() or len(data) < start + int(length):
        raise WarcError(f"record at byte {at} is cut off")
    record.block = bytes(data[start : start + int(length)])
    after = start + int(length)
    return record, after + 4 if data.startswith(b"\r\n\r\n", after) else after


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of a response's block; all of it is body if there is no status line."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split(CRLF)
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The body of a chunked transfer, and whether it is whole: one that is cut off gives the bytes up to there. Bytes
    that don't begin with a chunk's size are no chunks and stay."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return (b"".join(parts), False) if at else (body, True)
        at, n = end + 2, int(size, 16)
        if not n:
            return b"".join(parts), True
        parts.append(body[at : at + n])
        if len(parts[-1]) < n:
            return b"".join(parts), False
        at += n + 2


def inflated(blocks, bits: int):
    """Blocks of what blocks of gzip (bits 31), zlib (15) or bare deflate (-15) hold."""
    unzip, total = zlib.decompressobj(bits), 0
    for block in blocks:
        while block and not unzip.eof:
            try:
                out = unzip.decompress(block, BLOCK)
            except zlib.error as broken:
                raise NoText(f"broken content encoding: {broken}") from broken
            block, total = unzip.unconsumed_tail, total + len(out)
            if total > MAX_BODY:
                raise NoText(f"a body of over {MAX_BODY} bytes")
            yield out
    if not unzip.eof:
        raise NoText("a coded body is cut off")


def _begun(blocks, size: int):
    """The first `size` bytes of blocks (all of fewer), and blocks that begin with them."""
    held, blocks = b"", iter(blocks)
    for block in blocks:
        held += block
        if len(held) >= size:
            break
    return held[:size], itertools.chain([held], blocks)


def entity(http: list[tuple[str, str]], body: bytes) -> tuple[str, str, object, bool]:
    """Media type (lower case, empty if not stated), content type as stated, blocks of the body without its codings, and
    whether the transfer is whole.

    A coding that the stored bytes don't show, as crawlers may have undone it, is passed over.
    """
    first = lambda name: next((v for k, v in http if k.lower() == name), "")
    whole = True
    if "chunked" in first("transfer-encoding").lower():
        body, whole = unchunked(body)
    blocks = (body[i : i + BLOCK] for i in range(0, len(body), BLOCK))
    for coding in reversed([c.strip().lower() for c in first("content-encoding").split(",")]):
        head, blocks = _begun(blocks, 2)
        if coding in ("gzip", "x-gzip"):
            blocks = inflated(blocks, 31) if head == b"\x1f\x8b" else blocks
        elif coding == "deflate":
            zlib_head = len(head) > 1 and head[0] & 15 == 8 and not (head[0] << 8 | head[1]) % 31
            blocks = inflated(blocks, 15 if zlib_head else -15)
        elif coding not in ("", "identity"):
            raise NoText(f"content encoding {coding}")
    kind = first("content-type")
    return kind.split(";")[0].strip().lower(), kind, blocks, whole


def charset(kind: str, body: bytes) -> str:
    """The codec of a body: by its byte order mark, the content type, or a meta element; UTF-8 if none is known."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return name
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    meta = None if found else re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", body[:PRESCANNED], re.I)
    name = found[1] if found else meta[1].decode("ascii", "replace") if meta else "utf-8"
    try:
        known = codecs.lookup(name)
    except LookupError:
        return "utf-8"
    if not known._is_text_encoding:
        return "utf-8"
    return "cp1252" if known.name in ("iso8859-1", "ascii") else known.name  # as browsers read these two


def sniffed(head: bytes) -> str:
    """The media type of a body that states none, by its first SNIFFED bytes."""
    if _MARKUP.match(head):
        return HTML[0]
    marked = head.startswith((codecs.BOM_UTF8, codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE))
    return PLAIN if marked or not _BINARY.search(head) else "unknown bytes"


def body_text(http: list[tuple[str, str]], body: bytes) -> tuple[str, bool]:
    """The text of a response's body, and whether its transfer is whole. Raises NoText where it has none. The body
    passes in blocks, so that beside it only its text is held."""
    media, kind, blocks, whole = entity(http, body)
    head, blocks = _begun(blocks, SNIFFED)
    if not media:
        media = sniffed(head)
        if media == PLAIN and head.startswith((codecs.BOM_UTF8, codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            opening = head.decode(charset("", head), "ignore").encode()
            media = HTML[0] if _MARKUP.match(opening.lstrip(codecs.BOM_UTF8)) else media
    if media not in HTML and media != PLAIN:
        raise NoText(f"no text in {media}")
    decoder = codecs.getincrementaldecoder(charset(kind, head))("replace")
    page = VisibleText() if media in HTML else None
    plain: list[str] = []
    for block in itertools.chain(blocks, [None]):
        text = decoder.decode(b"", True) if block is None else decoder.decode(block)
        page.feed(text) if page else plain.append(text)
    return (page.text() if page else "".join(plain).replace("\r\n", "\n").strip()), whole


class VisibleText:
    """The visible text of a page that comes in pieces, by one scan forward.

    Comments, scripts, styles, templates and the like go, block tags break lines, other tags vanish, entities are
    resolved, blanks collapse; line breaks stay in preformatted elements. A head goes as a whole; one without a closing
    tag ends, as in HTML, before the first text or element that can't be in a head. What is open at the end of the page
    goes: a comment, a hidden element, a tag.
    """

    def __init__(self):
        self.out: list[str] = []
        self.held, self.need = "", 0
        self.until: str | None = None  # the hidden element or comment whose end is awaited
        self.head_from: int | None = None  # where the head's output begins
        self.in_head, self.pre = False, 0

    def feed(self, text: str) -> None:
        self.held += text
        if len(self.held) >= self.need:
            self._scan(False)

    def text(self) -> str:
        self._scan(True)
        return _LINES.sub("\n", _SPACES.sub(" ", "".join(self.out))).strip()

    def _said(self, text: str) -> None:
        if not text or self.in_head and not text.strip():
            return
        self.in_head = False
        self.out.append(html.unescape(text if self.pre else text.replace("\n", " ")))

    def _ended(self, at: int) -> int:
        """The place after the end of what is awaited, or -1."""
        if self.until == "--":
            end = self.held.find("-->", at)
            return -1 if end < 0 else end + 3
        found = re.compile(rf"</{self.until}(?=[\s/>])[^>]*>", re.I).search(self.held, at)
        return found.end() if found else -1

    def _scan(self, last: bool) -> None:
        held, at = self.held, 0
        while True:
            if self.until is not None:
                end = self._ended(at)
                if end < 0:
                    # Only an end that has begun can matter: an end tag of this name, or two marks of a comment's end.
                    rest = held[at:]
                    begun, name = rest.rfind("</"), rest[rest.rfind("</") + 2 :][: len(self.until)].lower()
                    if self.until != "--" and begun >= 0 and self.until.startswith(name):
                        self.held, self.need = rest[begun:], 2 * (len(rest) - begun) if name == self.until else 0
                    else:
                        self.held, self.need = rest[-2:], 0
                    return
                at, self.until = end, None
                if not self.in_head:
                    self.out.append(" ")
            start = held.find("<", at)
            if start < 0:
                stop = len(held)
                if not last and (amp := held.rfind("&", max(at, stop - 64))) >= 0:
                    stop = amp  # an entity may go on in the next piece
                self._said(held[at:stop])
                self.held, self.need = held[stop:], 0
                return
            self._said(held[at:start])
            if not last and len(held) - start < 4:
                self.held, self.need = held[start:], 0
                return
            at = start
            if held.startswith("<!--", at):
                self.until, at = "--", at + 4
                continue
            tag = _TAG.match(held, at)
            if tag:
                at = tag.end()
                self._tag(bool(tag[1]), tag[2].lower())
                continue
            follows = held[at + 1 : at + 3]
            if follows[:1] in ("!", "?") or (follows[:1] == "/" and not follows[1:2].isalpha()):
                end = held.find(">", at)
            elif follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/":
                end = -1
            else:
                self._said("<")
                at += 1
                continue
            if end < 0:
                # A tag that isn't closed yet; it is looked at again when as much has come once more.
                self.held, self.need = ("", 0) if last else (held[at:], 2 * (len(held) - at))
                return
            at = end + 1

    def _tag(self, closes: bool, name: str) -> None:
        if name == "head":
            if closes and self.head_from is not None:
                del self.out[self.head_from :]
                self.out.append(" ")
                self.head_from, self.in_head = None, False
            elif not closes and self.head_from is None:
                self.head_from, self.in_head = len(self.out), True
            return
        if self.in_head and not closes and name not in _IN_HEAD:
            self.in_head = False
        if not closes and (name in _HIDDEN or self.in_head and name in _HEAD_TEXT):
            self.until = name
        elif not self.in_head:
            if name == "pre":
                self.pre = max(0, self.pre + (-1 if closes else 1))
            if name in _BREAKS:
                self.out.append("\n")


def plain_text(page: str) -> str:
    """The visible text of a page."""
    scan = VisibleText()
    scan.feed(page)
    return scan.text()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{kind} {source}'.encode()).digest()[:16], version=4)}>"


def derive(data: bytes) -> tuple[Record, str, bytes, bytes | None, str | None, str | None]:
    """(the response, its payload digest, its metadata record, its conversion record, the plain text, why it has none)."""
    response, _ = parse_at(data)
    source = response.get("WARC-Record-ID")
    if response.get("WARC-Type") != "response" or not source:
        raise WarcError("not a response with an identifier")
    status, http, body = parse_http(response.block)
    text, why, whole = None, None, True
    try:
        text, whole = body_text(http, body)
    except NoText as none:
        why = str(none)
    ids = {kind: derived_id(source, kind) for kind in ("metadata", "conversion")}
    same = [(k, response.get(k)) for k in ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID", "WARC-IP-Address")]
    payload = response.get("WARC-Payload-Digest") or digest(body)
    fields = [
        ("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in http),
        ("source-block-digest", response.get("WARC-Block-Digest") or digest(response.block)),
        ("source-payload-digest", payload), ("source-content-length", str(len(response.block))),
        *([] if whole else [("source-truncated", "a chunk of the transfer is cut off")]),
        *([("no-conversion", why)] if text is None else [("conversion", ids["conversion"]), ("text-length", str(len(text)))]),
    ]
    block = "".join(f"{k}: {v}{CRLF}" for k, v in fields).encode()
    head = lambda kind, other, content: [
        ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *same, ("WARC-Refers-To", source),
        ("WARC-Concurrent-To", None if text is None else ids[other]), ("Content-Type", content),
    ]
    metadata = serialize(head("metadata", "conversion", "application/warc-fields"), block)
    wet = [*head("conversion", "metadata", "text/plain; charset=utf-8"), ("WARC-Source-Payload-Digest", payload), ("WARC-Truncated", None if whole else "unspecified")]
    conversion = None if text is None else serialize(wet, text.encode("utf-8", "replace"))
    return response, payload, metadata, conversion, text, why


def response_record(key: str, url: str | None, page: str | None) -> bytes:
    """A response record for a page that was stored without its headers."""
    body = (page or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(body)}{CRLF * 2}".encode()
    block = http + body
    return serialize(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", derived_id(key, "response")), ("WARC-Target-URI", url),
            ("WARC-Date", PAGE_DATE), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def _mapped(df: DataFrame, keep: list[str], inputs: list[str], fields: list[StructField], one) -> DataFrame:
    """keep and fields, with one(values of inputs) giving zero or more rows of the fields for each row."""
    schema = StructType([df.schema[c] for c in keep] + fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [one(*x) for x in zip(*(part.column(len(keep) + i).to_pylist() for i in range(len(inputs))))]
                take = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                rows = [r for rows in found for r in rows]
                columns = [part.column(i).take(take) for i in range(len(keep))]
                columns += [pa.array([r[i] for r in rows], arrow.field(len(keep) + i).type) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*keep, *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)]).mapInArrow(run, schema)


def page_responses(pages: DataFrame, keep: list[str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The columns `keep` of pages with record (binary): a response record whose identifier derives from id and url."""
    fields = [StructField("record", BinaryType())]
    names = [c for c in keep if c != "record"]
    one = lambda key, url, page: [(response_record(f"{key} {url}", url, page),)]
    return _mapped(pages, names, [id_col, url_col, html_col], fields, one)


DERIVED = [
    StructField("response_id", StringType()), StructField("target_uri", StringType()), StructField("metadata_id", StringType()),
    StructField("conversion_id", StringType()), StructField("payload_digest", StringType()), StructField("n_chars", LongType()),
    StructField("text", StringType()), StructField("metadata", BinaryType()), StructField("conversion", BinaryType()),
    StructField("error", StringType()),
]


def derivatives(responses: DataFrame, keep: list[str], record_col: str = "record") -> DataFrame:
    """The columns `keep` of responses with DERIVED: identifiers, the plain text, both records, and error.

    Defined cases: a null or broken record, or one that is no response, has its error and nulls. A response without
    text (another media type, an unknown or broken coding, a body of over MAX_BODY bytes, which fits no cell) has its
    error, a metadata record and no conversion. A chunked transfer that is cut off gives the text up to there, and both
    records say so. A type that isn't stated is sniffed from the first SNIFFED bytes. An empty body gives an empty text; texts of any length are converted whole. A response without a target address gives records without one. Repeated rows give repeated rows
    with equal identifiers. Columns of the names above are replaced; an empty table gives an empty result.
    """
    names = [c for c in keep if c not in {f.name for f in DERIVED}]

    def one(data):
        try:
            if data is None:
                raise WarcError("no record")
            response, payload, metadata, conversion, text, why = derive(bytes(data))
        except WarcError as broken:
            return [(None,) * 9 + (str(broken),)]
        source = response.get("WARC-Record-ID")
        return [
            (
                source, response.get("WARC-Target-URI"), derived_id(source, "metadata"),
                None if text is None else derived_id(source, "conversion"), payload, None if text is None else len(text), text,
                metadata, conversion, why,
            )
        ]

    return _mapped(responses, names, [record_col], DERIVED, one)


def write_warc(records: DataFrame, record_col: str, path: str) -> None:
    """Write a binary column of whole records as gzipped files, one a partition, a member a record. Nulls are left out.

    Spark's text writer puts out the bytes as they are. A member ends with its record's length in four bytes, of which
    the last is zero under 16 MB, so that a zero serves as line end; a longer record is followed by an empty member.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                member = gzip.compress(raw, 6, mtime=0) + (gzip.compress(b"", 6, mtime=0) if len(raw) >> 24 else b"")
                yield pa.RecordBatch.from_arrays([pa.array([member[:-1]], pa.binary())], ["member"])

    some = records.where(F.col(record_col).isNotNull()).select(record_col)
    some.mapInArrow(run, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


def blocks_of(data: bytes, size: int = 1 << 20):
    """The bytes of a file block by block, unzipped member after member if it is gzipped. Raises zlib.error."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(view), size):
            yield bytes(view[at : at + size])
        return
    at = 0
    while at < len(view):
        unzip = zlib.decompressobj(31)
        while at < len(view) and not unzip.eof:
            part = view[at : at + size]
            yield unzip.decompress(part)
            at += len(part) - len(unzip.unused_data)
        if not unzip.eof:
            raise zlib.error("a gzip member is cut off")


def records_of(data: bytes):
    """(record, None) of each record of a file, then (None, error) if it breaks off. Holds one record and a block."""
    held, blocks, more = bytearray(), blocks_of(data), True
    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[:1]
        try:
            if not held and not more:
                return
            if len(held) >= 5 and not held.startswith(b"WARC/"):
                yield None, "bytes that are no record"
                return
            record, after = parse_at(held)
        except WarcError as broken:
            if not more:
                yield None, str(broken)
                return
            try:
                held += next(blocks)
            except StopIteration:
                more = False
            except zlib.error as bad:
                yield None, str(bad)
                return
            continue
        head = held.find(b"\r\n\r\n") + 4
        yield bytes(held[: head + len(record.block)]) + b"\r\n\r\n", None
        del held[:after]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record binary, error) of every record of the files under path, plain or gzipped, one task a file.

    A file is read whole, up to the 2 GB of a binary value; it is unzipped block by block and its records leave the task
    in small batches. A file that breaks off gives its records up to there and a row with the error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        def out(name, rows):
            columns = [pa.array([name] * len(rows)), pa.array([r for r, _ in rows], pa.binary()), pa.array([e for _, e in rows], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["path", "record", "error"])

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row in records_of(data.as_py()):
                    rows.append(row)
                    held += len(row[0] or b"")
                    if held > 1 << 23:
                        yield out(name.as_py(), rows)
                        rows, held = [], 0
                yield out(name.as_py(), rows)

    return files.mapInArrow(run, "path string, record binary, error string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's two records with their identifiers and the plain text."""
    return derivatives(page_responses(table(spark, sf_dir, "pages"), ["page_id"]), ["page_id"])
