"""WARC derivatives: metadata and plain-text conversion records linked to responses.

``responses`` frames pages as WARC/1.1 response records. ``derivatives`` reads response
records and makes, for each, a metadata record (JSON: the source record's headers, the
HTTP status and headers, title, meta tags and links) and a conversion record (plain text
of the HTML). Both name the response in WARC-Refers-To, keep its target URI and date, and
carry its payload digest; block digests are their own. Record ids are name-based UUIDs of
the source id and type, so a repeated task makes the same records.

One pass per row, no shuffle: a host or page of any weight splits with the input.

Defined results: a null URL leaves the target URI out; null HTML is an empty payload;
white space and control characters in a URL are percent-encoded; repeated rows give
repeated records (same id); an unclosed comment, script or style runs to the end of the
page; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm.textbytes import text_session

CAPTURED = "2024-01-01T00:00:00Z"
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.S | re.I)
_HEAD, _HEAD_END = re.compile(r"<head\b", re.I), re.compile(r"</head\s*>|(?=<body\b)", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def framed(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", text).split("\r\n")      # a folded line goes on
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = fields(lines)
    return headers, block[:int(headers.get("Content-Length", len(block)))]


def fields(lines: list[str]) -> dict[str, str]:
    """Header lines by name; what has no colon is passed over."""
    return {k.strip(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


def response(page_id: str, url: str | None, page: str | None, date: str = CAPTURED) -> bytes:
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = [] if url is None else [("WARC-Target-URI", uri(url))]
    return framed([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url or "")), ("WARC-Date", date), *target,
                   ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))], block)


def plain_text(page: str) -> str:
    """Visible text: one line for each block element, white space collapsed."""
    page = _SKIPPED.sub(" ", page)
    head = _HEAD.search(page)
    end = head and _HEAD_END.search(page, head.end())      # a later head has no end that the first lacks
    if end:
        page = page[:head.start()] + " " + page[end.end():]
    page = _TAG.sub(lambda m: "\n" if (m[2] or "").lower() in _BLOCK else "" if m[2] else " ", re.sub(r"\s+", " ", page))
    lines = (" ".join(html.unescape(x).split()) for x in page.split("\n"))
    return "\n".join(x for x in lines if x)


def outline(page: str) -> dict:
    """Title, meta tags and links of a page."""
    title = _TITLE.search(page)
    metas, links = [], []
    for m in _TAG.finditer(_SKIPPED.sub(lambda m: m[0][:m[0].find(">") + 1] if m[1] else " ", page)):
        name = (m[2] or "").lower()
        if m[1] or name not in _LINKS and name != "meta":
            continue
        found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])}
        if name == "meta":
            metas.append(found)
        elif found.get(_LINKS[name]):
            links.append({"path": f"{name}@{_LINKS[name]}", "url": found[_LINKS[name]]})
    return {"Title": " ".join(html.unescape(title[1]).split()) if title else None, "Metas": metas, "Links": links}


def derived(record: bytes) -> list[tuple[str, str, str, bytes, dict]]:
    """(type, id, refers-to, record, its headers) of the two records made from a response."""
    source, block = parsed(record)
    if source.get("WARC-Type", "response") != "response":       # requests, revisits and the like have no page
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    page = payload.decode("utf-8", "replace")
    origin, kept = source["WARC-Record-ID"], [(k, source[k]) for k in ("WARC-Target-URI", "WARC-Date") if k in source]
    envelope = {"Envelope": {
        "WARC-Header-Metadata": source, "Block-Digest": source.get("WARC-Block-Digest"), "Payload-Digest": source.get("WARC-Payload-Digest"),
        "HTTP-Response-Metadata": {"Response-Message": status, "Headers": fields(http),
                                   "Entity-Length": len(payload), "HTML-Metadata": outline(page)}}}
    out = []
    for kind, mime, body in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
        data, own = body.encode("utf-8", "replace"), record_id(kind, origin)
        headers = [("WARC-Type", kind), ("WARC-Record-ID", own), *kept, ("WARC-Refers-To", origin), ("Content-Type", mime),
                   *([("WARC-Source-Payload-Digest", source["WARC-Payload-Digest"])] if "WARC-Payload-Digest" in source else []), ("WARC-Block-Digest", digest(data))]
        out.append((kind, own, origin, framed(headers, data), dict(headers)))
    return out


RESPONSES = "page_id long, record binary"
DERIVED = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, "
           "source_digest string, block_digest string, n_bytes long, record string")


def _respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")))
        made = [response(str(i), u, h) for i, u, h in rows]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DERIVED.split(", ")]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for i, record in zip(b.column("page_id").to_pylist(), b.column("record").to_pylist()):
            for kind, own, origin, data, h in derived(record):
                for col, v in zip(cols, (i, kind, own, origin, h.get("WARC-Target-URI"), h.get("WARC-Source-Payload-Digest"), h["WARC-Block-Digest"], len(data), data.decode())):
                    col.append(v)
        types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html)."""
    text_session(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_respond, RESPONSES)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records (page_id, record)."""
    text_session(records.sparkSession)
    return records.select("page_id", "record").where("record is not null").mapInArrow(_derive, DERIVED)


def write_warc(derived_records: DataFrame, path: str) -> None:
    """WARC files of the records: each record is closed by the two line ends."""
    derived_records.select("record").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
