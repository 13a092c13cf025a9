"""WARC derivatives: responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.shared import over_batches, slices

RESPONSE = "page_id {key}, record_id string, target_uri string, date string, http_headers string, body string"
DERIVED = "page_id {key}, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, source_digest string, headers string, block string"
NEWLINE = "\r\n"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^<>]*+>(.*?)(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*+>", re.DOTALL | re.IGNORECASE)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\r\f\v ]+")
# Elements that break a line.
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


def digest(data: bytes) -> str:
    """Digest as archives write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """Record id that follows from what the record is made of, so a second run writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def convert(page: str) -> tuple[str, str, str, list[str]]:
    """``(plain text, title, language, links)`` of a page: scripts, styles and comments go, block elements break lines, entities are resolved."""
    out: list[str] = []
    title = lang = ""
    links: list[str] = []
    at = 0
    for token in _TOKEN.finditer(page):
        out.append(page[at:token.start()].replace("\n", " "))
        at = token.end()
        raw, name = token[1], token[4]
        if raw is not None:
            if raw.lower() == "title" and not title:
                title = " ".join(html.unescape(token[2]).split())
        elif name is not None:
            name = name.lower()
            if name in _BLOCKS:
                out.append("\n")
            if not token[3]:
                if name == "a" and (href := _HREF.search(token[5])):
                    links.append(html.unescape(next(g for g in href.groups() if g is not None)).strip())
                elif name == "html" and (found := _LANG.search(token[5])):
                    lang = found[1]
    out.append(page[at:].replace("\n", " "))
    lines = (_SPACE.sub(" ", html.unescape(line)).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), title, lang, links


def _one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def _record(kind: str, ident: str, refers_to: str, uri: str, date: str, content_type: str, block: str, source: str) -> tuple:
    data = block.encode("utf-8", "replace")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri), ("WARC-Date", date),
              ("WARC-Block-Digest", digest(data)), ("WARC-Refers-To-Payload-Digest", source), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
    headers = "WARC/1.1" + NEWLINE + "".join(f"{name}: {value}{NEWLINE}" for name, value in fields if value)
    return kind, ident, refers_to, uri, content_type, len(data), digest(data), source, headers, block


def derive_one(ident: str, uri: str | None, date: str | None, http_headers: str | None, body: str | None) -> list[tuple]:
    """The metadata record and the conversion record of one response."""
    uri, date, body = _one_line(uri), _one_line(date), body or ""
    text, title, lang, links = convert(body)
    source = digest(body.encode("utf-8", "surrogatepass"))
    conversion_id = record_id("conversion", ident)
    described = [("title", title), ("language", lang), ("converted-to", conversion_id), ("source-payload-digest", source)]
    described += [("source-header", _one_line(h)) for h in (http_headers or "").splitlines() if h.strip()]
    described += [("outlink", _one_line(link)) for link in dict.fromkeys(links) if _one_line(link)]
    about = "".join(f"{name}: {value}{NEWLINE}" for name, value in described if value)
    return [
        _record("metadata", record_id("metadata", ident), ident, uri, date, "application/warc-fields", about, source),
        _record("conversion", conversion_id, ident, uri, date, "text/plain; charset=utf-8", text, source),
    ]


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", "headers", "block"]
    types = [pa.int64() if n == "content_length" else pa.string() for n in names]
    for batch in slices(batches, 128):
        rows = [derive_one(*r) for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        columns = [pa.array(c, t) for c, t in zip(zip(*(r for pair in rows for r in pair)), types)]
        keys = batch.column(0).take(pa.array([i for i in range(len(rows)) for _ in range(2)], pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, *columns], ["page_id", *names])


def responses(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as response records: ``page_id, record_id, target_uri, date, http_headers, body``.

    The id follows from key, address and content; a null body is an empty one.
    """
    content = F.coalesce(F.col(body), F.lit(""))
    seed = F.sha2(F.concat_ws("\u0000", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), content), 256)
    ident = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(seed, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(content).cast("string"))
    return pages.select(F.col(key).alias("page_id"), ident.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"), status.alias("http_headers"), content.alias("body"))


def derive(found: DataFrame) -> DataFrame:
    """Two rows for every response: its ``metadata`` record (title, language, links, source headers and digest) and its ``conversion`` to plain text.

    Both name the response in ``refers_to`` and keep its address and date; ``source_digest`` is the digest of the response's payload, ``block_digest``
    that of the record's own block. ``headers`` and ``block`` are what ``write_warc`` writes. No row is moved between tasks.

    Null or blank bodies give empty conversions; null addresses, dates and headers are left out. Ids follow from the response's id, so repeated
    responses give repeated records. No responses give none; further columns play no part.
    """
    kind = found.schema["page_id"].dataType.simpleString()
    return over_batches(found.select("page_id", "record_id", "target_uri", "date", "http_headers", "body"), _derived, DERIVED.format(key=kind))


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzipped WARC files, one a task."""
    whole = F.concat("headers", F.lit(NEWLINE), "block")
    records.select(whole.alias("value")).write.option("lineSep", NEWLINE * 2).option("compression", "gzip").text(path)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of every record of an archive, gzipped as a whole, by record, or not at all."""
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        plain = member.decompress(content) + member.flush()
        content = member.unused_data
        yield from _plain_records(plain)
    yield from _plain_records(content)


def _plain_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        head, end = data[start:(stop := data.index(b"\r\n\r\n", start))].decode("utf-8", "replace"), stop + 4
        headers = dict(line.split(": ", 1) for line in head.split(NEWLINE)[1:] if ": " in line)
        size = int(headers["Content-Length"])
        yield headers, data[end:end + size]
        at = end + size


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        for content in batch.column(0).to_pylist():
            rows = []
            for headers, block in parse_records(content):
                if headers.get("WARC-Type") == "response":
                    http, _, body = block.partition(b"\r\n\r\n")
                    ident = headers.get("WARC-Record-ID", "")
                    rows.append((ident, ident, headers.get("WARC-Target-URI"), headers.get("WARC-Date"), http.decode("utf-8", "replace"), body.decode("utf-8", "replace")))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["page_id", "record_id", "target_uri", "date", "http_headers", "body"])


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, one file a row at a time; ``page_id`` is the record's id. Files should be cut to fit a worker's memory."""
    return over_batches(spark.read.format("binaryFile").load(path).select("content"), _read, RESPONSE.format(key="string"))
