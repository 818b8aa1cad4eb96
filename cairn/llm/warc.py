"""WARC responses to derived records: linked metadata and plain-text conversions.

Each response record gives a metadata record (title, language, links and the source's headers, as warc-fields) and, if it
is text, a conversion record (the page's plain text). Transfer and content codings (chunked, gzip, deflate) are undone
first; the digest of the source stays that of the payload as stored. Both name the response they derive from (WARC-Refers-To, with its target
URI and date), and carry their own block digests as well as the source's payload digest. Record ids are UUIDs of the
source's id, so that a task that runs again gives the same records.

``parse`` and ``serialize`` read and write the record format (gzip per record or plain), ``read_warc`` streams files
that Spark lists, and ``as_records`` gives derived records as the bytes of the file format.

Defined results: a null page or header counts as empty; a response without an id has null ids for itself and its
derived records are still made, without links; a body of another type than text, or of a coding that isn't known, gives a
metadata record only, which says so; of a damaged coding what can be read is converted; a record that can't be parsed comes back with its error and no
content; a charset that isn't one of pages counts as UTF-8, with what can't be read replaced; repeated rows each give
their records; an empty table gives none; very long pages are read whole, in time linear in their length; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

VERSION = "WARC/1.1"
RESPONSES = "record_id string, target_uri string, date string, http_headers string, payload binary"
DERIVED = (
    "record_id string, type string, refers_to string, refers_to_target_uri string, refers_to_date string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, block string"
)

#: Only comments, scripts and styles run to the end of the page if nothing ends them.
_ENDLESS = frozenset(("script", "style"))
#: Their contents aren't text.
_DROPPED = _ENDLESS | {"noscript", "template", "svg"}
_IN_HEAD = frozenset(("meta", "link", "base"))
_BREAKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav main aside blockquote pre hr title form dl dt dd body".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: A tag in plain order, its values in double quotes; all others are scanned attribute by attribute.
_PLAIN = re.compile(r"""</?[a-zA-Z][^\s"'>=/]*(?:\s+[^\s"'>=/]+(?:="[^"]*")?)*\s*/?>""")
_PLAIN_VALUES = re.compile(r"""\s([^\s"'>=/]+)(?:="([^"]*)")?""")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*_DROPPED, "title")}
_BARE = re.compile(r"[^\s>]*")
_LANG = re.compile(r"[A-Za-z0-9-]+")
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)
_META_CHARSET = re.compile(r"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Text encodings that no page is read by: they aren't safe or linear.
_ODD_CHARSETS = frozenset(("idna", "punycode", "undefined", "unicode_escape", "raw_unicode_escape", "utf_7"))
#: Bytes of payload that are read before rows are handed on.
READ_BYTES = 8 << 20


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str | None, kind: str) -> str | None:
    return source and f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


class Page:
    """One pass over a page: text with line ends, title, language and links. No part is looked at more than a few times."""

    def __init__(self, page: str):
        self.page, self.parts, self.links = page, [], []
        self.title: str | None = None
        self.language: str | None = None
        self._none_after: dict[str, int] = {}
        self._read()

    def _closed(self, name: str, at: int) -> re.Match | None:
        """The end tag of that name after at. That there is none is found out once."""
        if at >= self._none_after.get(name, len(self.page) + 1):
            return None
        found = _CLOSERS[name].search(self.page, at)
        if not found:
            self._none_after[name] = at
        return found

    def _quote(self, mark: str, at: int) -> int:
        """Where the mark stands next; that there is none is found out once."""
        if at >= self._none_after.get(mark, len(self.page) + 1):
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self._none_after[mark] = at
        return found

    def _tag(self, lt: int, at: int) -> tuple[dict[str, str], int]:
        """(attributes, where the tag's ">" stands or -1) of a tag that begins at lt and whose name ends at at; a name's first value counts.

        A ">" within quotes ends nothing. A quote that nothing closes is part of a bare value."""
        page = self.page
        if m := _PLAIN.match(page, lt):
            return dict(reversed([(k.lower(), v) for k, v in _PLAIN_VALUES.findall(page, at, m.end())])), m.end() - 1
        found: dict[str, str] = {}
        while True:
            at = _BETWEEN.match(page, at).end()
            if at >= len(page):
                return found, -1
            if page[at] == ">":
                return found, at
            m = _ATTRIBUTE.match(page, at)
            name, at, value = m[0].lower(), m.end(), ""
            if m := _EQUALS.match(page, at):
                at = m.end()
                mark = page[at : at + 1]
                end = self._quote(mark, at + 1) if mark and mark in "\"'" else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
            found.setdefault(name, value)

    def _read(self) -> None:
        page, parts, at, in_head = self.page, self.parts, 0, False
        while (lt := page.find("<", at)) >= 0:
            if lt > at:
                text = page[at:lt]
                in_head = in_head and not text.strip()
                parts.append(" " if in_head else text)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                parts.append(" ")
                at = end + 3 if end >= 0 else len(page)
                continue
            begins, named, attributes = page[lt + 1 : lt + 3].lstrip("/")[:1], _NAME.match(page, lt), {}
            if named:
                attributes, gt = self._tag(lt, named.end())
            else:
                gt = self._quote(">", lt) if begins in ("!", "?") else -2
            if gt < 0:
                if gt == -1:  # no tag ends after this
                    break
                parts.append("<")
                in_head, at = False, lt + 1
                continue
            closing, at = page[lt + 1] == "/", gt + 1
            name = named[1].lower() if named else ""
            if name in _DROPPED and not closing and (name in _ENDLESS or page[gt - 1] != "/"):
                end = self._closed(name, at)
                if end or name in _ENDLESS:
                    parts.append(" ")
                    at = end.end() if end else len(page)
                    continue
            if name == "a" and not closing:
                if "href" in attributes:
                    self.links.append(attributes["href"])
            elif name == "title" and not closing and (self.title is None or in_head) and (end := self._closed(name, at)):
                self.title = page[at : end.start()] if self.title is None else self.title
                if in_head:
                    at = end.end()
                    continue
            elif name == "html" and self.language is None and (m := _LANG.match(attributes.get("lang", "").strip())):
                self.language = m[0]
            if name == "head":
                in_head = not closing
                continue
            if in_head and name in _IN_HEAD:
                continue
            in_head = False
            if name in _BREAKS:
                parts.append("\n")
        parts.append(page[at:])

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in html.unescape("".join(self.parts)).split("\n"))
        return "\n".join(x for x in lines if x)

    def fields(self) -> list[tuple[str, str]]:
        """Names and values of the metadata record: title, language, links in order without repeats."""
        out = [("title", " ".join(html.unescape(self.title).split()))] if self.title is not None else []
        out += [("language", self.language)] if self.language else []
        links = (html.unescape(x).strip() for x in self.links)
        return out + [("outlink", x) for x in dict.fromkeys(links) if x and "\n" not in x]


def plain_text(page: str) -> str:
    """The page's text: scripts, styles and comments gone, block elements end lines, entities resolved, space collapsed."""
    return Page(page).text()


def header_values(headers: str) -> dict[str, str]:
    """Values by lower-case name; of a name that comes again, all, parted by commas."""
    out: dict[str, str] = {}
    for line in headers.replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def unchunked(data: bytes) -> bytes:
    """A chunked body put together; as it is where it isn't chunked after all, and what is there where its end is missing."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at, at + 1024)
        size = data[at : max(at, end)].split(b";")[0].strip()
        if end < 0 or not size or size.strip(b"0123456789abcdefABCDEF"):
            return data if not out else b"".join(out)
        n = int(size, 16)
        if not n:
            break
        out.append(data[end + 1 : end + 1 + n])
        at = end + 1 + n
        at = at + 2 if data[at : at + 2] == b"\r\n" else at + 1 if data[at : at + 1] == b"\n" else at
    return b"".join(out)


def inflated(data: bytes, coding: str) -> bytes | None:
    """The body without a coding; what could be read of a damaged one; null for codings that aren't known."""
    if coding in ("", "identity"):
        return data
    if coding in ("gzip", "x-gzip") and data[:2] != b"\x1f\x8b":
        return data  # said to be, and isn't
    if coding not in ("gzip", "x-gzip", "deflate"):
        return None
    for bits in (47,) if coding != "deflate" else (47, -15):
        out, rest = [], data
        try:
            while rest:  # members one after the other
                one = zlib.decompressobj(bits)
                for at in range(0, len(rest), 1 << 16):
                    out.append(one.decompress(rest[at : at + (1 << 16)]))
                    if one.eof:
                        break
                rest = (one.unused_data + rest[at + (1 << 16) :]) if one.eof and bits == 47 else b""
                rest = rest if rest[:2] == b"\x1f\x8b" else b""
            return b"".join(out)
        except zlib.error:
            if any(out):
                return b"".join(out)
    return data


#: Types besides text/ that are read as pages, and as plain text.
_PAGES, _TEXTS = ("text/html", "application/xhtml+xml", "application/xml", "text/xml"), ("application/json", "application/ld+json", "application/javascript", "application/x-ndjson")
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def body_of(payload: bytes, headers: str) -> tuple[str, bytes | None]:
    """(media type, body without transfer and content codings); no body where a coding isn't known."""
    values = header_values(headers)
    kind = values.get("content-type", "").split(";")[0].strip().lower() or "text/html"
    body: bytes | None = payload
    if "chunked" in values.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for coding in reversed([x.strip().lower() for x in values.get("content-encoding", "").split(",")]):
        body = inflated(body, coding) if body is not None else None
    return kind, body


def decoded(body: bytes, headers: str) -> str:
    """The page by its byte order mark, the charset of its headers, or that which its first kilobyte names; else by UTF-8.

    Names that are unknown or no encoding of pages count as UTF-8."""
    name = "utf-8"
    mark = next(((m, n) for m, n in _MARKS if body.startswith(m)), None)
    if mark:
        body, name = body[len(mark[0]) :], mark[1]
    else:
        told = _CHARSET.search(header_values(headers).get("content-type", ""))
        told = told or _META_CHARSET.search(body[:1024].decode("latin-1"))
        try:
            found = codecs.lookup(told[1]) if told else None
            if found and found._is_text_encoding and found.name.replace("-", "_") not in _ODD_CHARSETS:
                name = found.name if not (told.re is _META_CHARSET and found.name.startswith("utf-16")) else "utf-8"
        except (LookupError, ValueError):  # unknown names
            pass
    try:
        page = body.decode(name, "replace")
    except (LookupError, ValueError):  # codecs that refuse the bytes
        page = body.decode("utf-8", "replace")
    return _SURROGATE.sub("\ufffd", page)


def derived_records(record_id: str | None, uri: str | None, date: str | None, headers: str | None, payload: bytes | None) -> list[tuple]:
    headers, payload = headers or "", payload or b""
    source = digest(payload)
    kind, body = body_of(payload, headers)
    fields, text = [], None
    if body is None:
        fields.append(("not-converted", f"content coding {header_values(headers).get('content-encoding')}"))
    elif kind in _PAGES or kind.endswith("+xml"):
        page = Page(decoded(body, headers))
        fields, text = page.fields(), page.text()
    elif kind.startswith("text/") or kind in _TEXTS:
        lines = (" ".join(x.split()) for x in decoded(body, headers).split("\n"))
        text = "\n".join(x for x in lines if x)
    else:
        fields.append(("not-converted", f"content type {kind}"))
    fields += [("source-header", x.strip()) for x in headers.replace("\r\n", "\n").split("\n")[1:] if ":" in x]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields))] + ([("conversion", "text/plain", text)] if text is not None else [])
    out = []
    for what, mime, block in made:
        data = block.encode()
        out.append((derived_id(record_id, what), what, record_id, uri, date, uri, date, mime, len(data), digest(data), source, headers, block))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """The derived records of each response (columns as in RESPONSES): metadata, and a conversion where it is text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in DERIVED.split(", "))])
        for b in slices(batches, 256):
            rows = [r for x in zip(*(c.to_pylist() for c in b.columns)) for r in derived_records(*x)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    names = [f.split()[0] for f in RESPONSES.split(", ")]
    return responses.select(*names).mapInArrow(run, DERIVED)


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None) -> DataFrame:
    """Response records for a table of pages."""
    body = F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b""))
    key = F.sha1(F.concat_ws("\n", F.col(id_col).cast("string"), F.col(url_col)))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    ident = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(key, a, n) for a, n in parts]), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n"))
    when = F.lit("1970-01-01T00:00:00Z") if date is None else date
    return pages.select(F.when(F.col(id_col).isNotNull(), ident).alias("record_id"), F.col(url_col).alias("target_uri"), when.alias("date"), head.alias("http_headers"), body.alias("payload"))


def serialize(headers: list[tuple[str, str]], block: bytes, compress: bool = True) -> bytes:
    """One record; Content-Length is added."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    data = f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def parse(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file, gzip or plain; holds one record at a time."""
    raw = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers.get("content-length", 0))
        block = stream.read(n)
        if n < 0 or len(block) < n:
            raise ValueError("a record is cut short")
        yield headers, block


def opened(path: str) -> BinaryIO:
    """A file of any store that Arrow knows (local, HDFS, S3, ...), as a stream."""
    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_stream(at, compression=None)


def read_warc(spark: SparkSession, path: str, open_file: Callable[[str], BinaryIO] = opened) -> DataFrame:
    """Response records of WARC files; error tells of files that end badly (a record of its own, after the good ones).

    Spark lists the files; each is read as a stream in a worker, so only READ_BYTES and one record are held however
    long the file is. open_file: how a worker opens a listed path, for stores that Arrow doesn't know."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("http_headers", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return made

        for b in batches:
            for at in b.column(0).to_pylist():
                try:
                    size = 0
                    with open_file(at) as source:
                        for h, block in parse(source):
                            if h.get("warc-type") == "response":
                                head, _, body = block.partition(b"\r\n\r\n")
                                rows.append((h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), head.decode("utf-8", "replace") + "\r\n", body, None))
                                size += len(body)
                                if size >= READ_BYTES:
                                    yield out()
                                    size = 0
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    rows.append((None, at, None, None, None, str(e)))
                if rows:
                    yield out()

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(run, RESPONSES + ", error string")


def as_records(derived: DataFrame) -> DataFrame:
    """(record_id, record binary): each derived record in the file format, gzip by itself.

    WARC-Payload-Digest is that of the payload referred to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            out = []
            for r in b.to_pylist():
                head = [("WARC-Type", r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Refers-To-Target-URI", r["refers_to_target_uri"]),
                        ("WARC-Refers-To-Date", r["refers_to_date"]), ("WARC-Block-Digest", r["block_digest"]), ("WARC-Payload-Digest", r["source_payload_digest"]), ("Content-Type", r["content_type"])]
                out.append(serialize(head, (r["block"] or "").encode()))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["record_id", "record"])

    return derived.mapInArrow(run, "record_id string, record binary")
