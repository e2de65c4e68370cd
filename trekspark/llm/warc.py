"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekspark.llm.common import read_table

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
PIECE_BYTES = 1 << 20
FIELDS = "record_id string, warc_type string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, other_headers string, block binary"

_DROPPED = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_NO_LINKS = re.compile(r"<!--.*?(?:-->|$)|(<(script|style)\b[^>]*>).*?(?:</\2\s*>|$)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul|title|body|head|html)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_LINK = re.compile(r"<(a|area|link|img|script|iframe|form)\b[^>]*?\b(?:href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """Text of a page: no scripts, styles, comments or tags; a line per block element; entities decoded."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", page))))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def page_metadata(page: str) -> dict:
    title = _TITLE.search(page)
    metas = []
    for m in _META.finditer(page):
        pairs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[1])}
        metas.append(pairs)
    links = [{"path": f"{m[1].lower()}", "url": html.unescape(m[2] or m[3] or m[4] or "")} for m in _LINK.finditer(_NO_LINKS.sub(r"\1 ", page))]
    return {"title": " ".join(html.unescape(title[1]).split()) if title else None, "metas": metas, "links": links}


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and payload of an HTTP message; a block without a head is all payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


#: Names of text encodings that pages are declared in; other names are read as UTF-8.
CHARSETS = frozenset(
    "utf-8 utf8 utf-16 utf-16le utf-16be utf-32 us-ascii ascii iso-8859-1 iso-8859-2 iso-8859-3 iso-8859-4 iso-8859-5 iso-8859-6 iso-8859-7 iso-8859-8 iso-8859-9 iso-8859-10 iso-8859-11 iso-8859-13 iso-8859-14 iso-8859-15 iso-8859-16 "
    "latin-1 latin1 windows-874 windows-1250 windows-1251 windows-1252 windows-1253 windows-1254 windows-1255 windows-1256 windows-1257 windows-1258 cp1250 cp1251 cp1252 cp866 koi8-r koi8-u macintosh "
    "gb2312 gbk gb18030 big5 big5-hkscs shift_jis shift-jis sjis euc-jp iso-2022-jp euc-kr ks_c_5601-1987 cp949 johab tis-620".split()
)


def charset_of(headers: list[tuple[str, str]]) -> str:
    for k, v in headers:
        if k.lower() == "content-type" and (m := re.search(r"charset\s*=\s*[\"']?([\w.-]+)", v, re.I)):
            name = m[1].lower()
            return {"windows-874": "cp874", "macintosh": "mac-roman"}.get(name, name) if name in CHARSETS else "utf-8"
    return "utf-8"


def decoded(payload: bytes, charset: str) -> str:
    """The payload as text; what cannot be read is replaced, and UTF-8 stands in for an encoding that this Python lacks."""
    try:
        return payload.decode(charset, "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


def more_headers(text: str | None) -> dict:
    """Fields of other_headers; a text that is no JSON object is kept as it is, under that name."""
    try:
        fields = json.loads(text or "{}")
    except ValueError:
        fields = None
    return fields if isinstance(fields, dict) else {"other_headers": text}


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html): page_id and the record's fields. A null page has
    an empty payload; a null url gives a null target_uri. Record ids follow from page_id and url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (page or "").encode("utf-8", "replace")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                rows.append((record_id("response", page_id, url), "response", None, None, url, date, "application/http; msgtype=response", len(block), digest(block), digest(payload), None, block))
            yield _records(rows, {"page_id": batch.column("page_id")})

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, {FIELDS}")


_TYPES = {name: {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind] for name, kind in (x.split() for x in FIELDS.split(", "))}


def _records(rows: list[tuple], first: dict[str, pa.Array]) -> pa.RecordBatch:
    """Records as a batch, after columns that are passed on as they are."""
    columns = zip(*rows) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([*first.values(), *(pa.array(x, t) for x, t in zip(columns, _TYPES.values()))], names=[*first, *_TYPES])


def derivatives(responses: DataFrame, key: str | None = None) -> DataFrame:
    """Two records of each response: metadata (JSON: all the source's WARC fields, HTTP status and headers,
    title, meta elements, links) and conversion (plain text). Both refer to the response by its id, are
    concurrent to each other, keep its target_uri and date and carry its payload digest; content_length
    and block_digest are those of the new block. ``key`` names a column to pass on. Records of other
    types give nothing; a declared charset that is not in CHARSETS is read as UTF-8, and other_headers that are no
    JSON object stay as a text; a null or empty block gives an empty text and no title. Repeated rows give repeated
    records; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in _TYPES}
                status, headers, payload = split_http(r["block"] or b"")
                page = decoded(payload, charset_of(headers))
                source = digest(payload) if r["payload_digest"] is None else r["payload_digest"]
                envelope = {name: source if field == "payload_digest" else r[field] for field, name in _HEADERS.items()} | more_headers(r["other_headers"])
                meta = {"warc": {k: v for k, v in envelope.items() if v is not None}, "http": {"status": status, "headers": headers}, "html": page_metadata(page)}
                ids = {t: record_id(t, r["record_id"]) for t in ("metadata", "conversion")}
                for kind, content, block in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False).encode("utf-8", "replace")), ("conversion", "text/plain", plain_text(page).encode("utf-8", "replace"))):
                    other = ids["conversion" if kind == "metadata" else "metadata"]
                    at.append(i)
                    rows.append((ids[kind], kind, r["record_id"], other, r["target_uri"], r["date"], content, len(block), digest(block), source, None, block))
            yield _records(rows, {key: batch.column(key).take(pa.array(at, pa.int32()))} if key else {})

    kept = responses.where("warc_type = 'response'").select(*([key] if key else []), *_TYPES)
    return kept.mapInArrow(run, f"{key} {responses.schema[key].dataType.simpleString()}, {FIELDS}" if key else FIELDS)


_HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length"}


def serialized(record: dict) -> bytes:
    """A WARC/1.1 record as bytes, from a dictionary of the fields above. Fields that are missing or null are left out."""
    fields = {name: record[field] for field, name in _HEADERS.items() if record.get(field) is not None} | more_headers(record.get("other_headers"))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + bytes(record.get("block") or b"") + b"\r\n\r\n"


def _lines(stream: io.IOBase) -> bytes:
    """The next line; nothing where a compressed stream ends early or is damaged."""
    try:
        return stream.readline()
    except (EOFError, OSError, zlib.error):
        return b""


def _bytes(stream: io.IOBase, n: int) -> bytes:
    """The next ``n`` bytes or those that are there, in pieces, so that a wrong length asks for no memory."""
    parts = []
    while n > 0:
        try:
            part = stream.read(min(n, PIECE_BYTES))
        except (EOFError, OSError, zlib.error):
            break
        if not part:
            break
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def parsed(data: bytes | io.IOBase) -> Iterator[dict]:
    """The records of a WARC file, from its bytes or a stream. Fields without a column come as JSON in other_headers.
    A record without a readable length (digits, 18 at most), or cut off within its head, is passed over; one cut off within its block keeps
    what is there, and its stated length. A compressed stream that ends early or is damaged ends there."""
    fields, stream = {v.lower(): k for k, v in _HEADERS.items()}, io.BytesIO(data) if isinstance(data, (bytes, bytearray)) else data
    while line := _lines(stream):
        if not line.startswith(b"WARC/"):
            continue
        record, other = dict.fromkeys(_TYPES), {}
        while (line := _lines(stream)).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip(), value.strip()
            if name.lower() in fields:
                record[fields[name.lower()]] = value
            else:
                other[name] = value
        length = str(record["content_length"] or "0")
        if not line or not (length.isascii() and length.isdigit() and len(length) <= 18):
            continue
        record |= {"content_length": int(length), "other_headers": json.dumps(other) if other else None, "block": _bytes(stream, int(length))}
        yield record


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip, as columns of FIELDS. One task holds one file (at most 2 GB, as binaryFile
    has it) and decompresses it as it goes; broken records are passed over as ``parsed`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = io.BytesIO(content.as_py())
                rows, held = [], 0
                for record in parsed(gzip.GzipFile(fileobj=data) if data.getvalue()[:2] == b"\x1f\x8b" else data):
                    rows.append(tuple(record[c] for c in _TYPES))
                    held += len(record["block"])
                    if held > 1 << 24:
                        yield _records(rows, {})
                        rows, held = [], 0
                if rows:
                    yield _records(rows, {})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FIELDS)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derivatives(response_records(read_table(spark, sf_dir, "pages")), key="page_id")
    return records.select("page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", F.col("block").cast("string").alias("content"))
