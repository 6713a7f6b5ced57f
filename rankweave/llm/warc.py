"""WARC derivatives: metadata and plain-text conversion records made from response records.

``derive`` reads each response record (as bytes), checks its digests, and builds two records that
refer to it by ``WARC-Refers-To``: a metadata record whose JSON holds the source's record headers,
the HTTP status and headers, the page's title and its links, and a conversion record with the plain
text.  Both keep the source's target, date, filename and digests.  Record ids are name-based, so a
task that is run again makes the same records.

Defined results: a record of another type, null or bytes that don't parse: no derivatives, and
``problem`` says why.  A response without a body: empty text.  A page with null url has a response
without a target; null html is an empty body.  Repeated responses get equal derivatives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.html_tokens import tags
from rankweave.llm.textbatch import column, slices

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  #: the standard name space of URLs
BATCH_BYTES = 8_000_000
KEPT = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Filename", "WARC-Warcinfo-ID")

_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_ADDRESS = re.compile(r"\s(href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^>]*+>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
LINKING = frozenset("a area link img script iframe form".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def _clean(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; its length is added, the order of headers is kept."""
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers)
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """All records of uncompressed WARC bytes."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("not a record")
        headers: list[tuple[str, str]] = []
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in " \t" and headers:  # a folded header goes on
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                k, _, v = line.partition(":")
                headers.append((k.strip(), v.strip()))
        size = next((v for k, v in headers if k.lower() == "content-length"), "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            raise ValueError("a record without its whole block")
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        while data.startswith(b"\r\n", at):
            at += 2
        yield [h for h in headers if h[0].lower() != "content-length"], block


def read_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not status.startswith("HTTP/"):
        raise ValueError("not an HTTP response")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def plain_text(html: str) -> str:
    """A page's visible text, a line for each block, white space inside lines as one space."""
    seen = _UNSEEN.sub(" ", html)
    end = seen.rfind(">") + 1  # no tag ends behind it, so that none is looked for in vain
    text = entities.unescape(_TAG.sub("", _BREAK.sub("\0", seen[:end])) + seen[end:])
    return "\n".join(line for part in text.split("\0") if (line := " ".join(part.split())))


def links(html: str) -> list[dict[str, str]]:
    """The first address of each linking tag outside scripts and the like."""
    out = []
    for _, _, closing, name, attributes in tags(_UNSEEN.sub(" ", html)):
        if name in LINKING and not closing and (m := _ADDRESS.search(f" {attributes}")):
            out.append({"path": f"{name.upper()}@/{m[1].lower()}", "url": entities.unescape(m[2] or m[3] or m[4] or "")})
    return out


def told(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name; one that is repeated has all its values, in order."""
    out: dict[str, str | list[str]] = {}
    for k, v in headers:
        out[k] = v if k not in out else [*(out[k] if isinstance(out[k], list) else [out[k]]), v]
    return out


def response(page_key: str, url: str | None, html: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The response record of a page."""
    body = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_key, url or "")), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
    return write_record(headers, block)


def derivatives(record: bytes | None) -> dict:
    """Both records made from one response record, with what identifies them."""
    try:
        found = list(read_records(record or b""))
        if len(found) != 1:
            raise ValueError("not one record")
        headers, block = found[0]
        by = {k.lower(): v for k, v in headers}
        if by.get("warc-type") != "response" or not by.get("warc-record-id"):
            raise ValueError("not a response")
        if by.get("warc-block-digest", "sha1:").startswith("sha1:") and by.get("warc-block-digest", digest(block)) != digest(block):
            raise ValueError("the block has another digest")
        status, http, body = read_http(block)
    except ValueError as e:
        return {"problem": str(e)}
    source = by["warc-record-id"]
    payload_digest = by.get("warc-payload-digest") or digest(body)
    html = body.decode("utf-8", "replace")
    text, out_links = plain_text(html), links(html)
    title = _TITLE.search(html[: html.rfind(">") + 1])
    kept = [(k, v) for k, v in headers if k in KEPT]
    envelope = {
        "source": {"headers": told(headers), "block_digest": by.get("warc-block-digest") or digest(block), "payload_digest": payload_digest, "payload_length": len(body)},
        "http": {"status": status, "headers": told(http)},
        "html": {"title": " ".join(entities.unescape(title[1]).split()) if title else None, "links": out_links},
    }
    about = json.dumps(envelope, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()
    plain = text.encode()
    ids = {k: record_id(k, source) for k in ("metadata", "conversion")}
    common = [("WARC-Refers-To", source), *kept]
    metadata = write_record([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *common, ("Content-Type", "application/json"), ("WARC-Block-Digest", digest(about))], about)
    conversion = write_record(
        [("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *common, ("Content-Type", "text/plain"), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Concurrent-To", ids["metadata"]), ("WARC-Block-Digest", digest(plain))],
        plain,
    )
    return {
        "refers_to": source, "metadata_id": ids["metadata"], "conversion_id": ids["conversion"], "source_block_digest": envelope["source"]["block_digest"], "source_payload_digest": payload_digest,
        "metadata_digest": digest(about), "conversion_digest": digest(plain), "n_links": len(out_links), "text": text, "metadata": metadata, "conversion": conversion, "problem": None,
    }


DERIVED = [
    *((k, "string", pa.string()) for k in ("refers_to", "metadata_id", "conversion_id", "source_block_digest", "source_payload_digest", "metadata_digest", "conversion_digest")),
    ("n_links", "int", pa.int32()), ("text", "string", pa.string()), ("metadata", "binary", pa.binary()), ("conversion", "binary", pa.binary()), ("problem", "string", pa.string()),
]


def _mapped(df: DataFrame, sources: list[str], added: list[tuple], function, drop: tuple[str, ...] = ()) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in {a[0] for a in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            inputs = [column(whole, s) for s in sources]
            others = [whole.column(whole.schema.get_field_index(f.name)) for f in kept]
            for lo, hi in slices([sum(len(x) for x in row if isinstance(x, str | bytes)) for row in zip(*inputs, strict=True)], BATCH_BYTES):
                rows = [function(*row) for row in zip(*(i[lo:hi] for i in inputs), strict=True)]
                new = [pa.array([r.get(a[0]) for r in rows], a[2]) for a in added]
                yield pa.RecordBatch.from_arrays([*(o.slice(lo, hi - lo) for o in others), *new], names=[*(f.name for f in kept), *(a[0] for a in added)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{a[0]}` {a[1]}" for a in added)])
    return df.mapInArrow(run, schema)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", record: str = "record") -> DataFrame:
    """``pages`` with each page's response record; a column named ``record`` is replaced."""
    return _mapped(pages.drop(record), [page_id, url, html], [(record, "binary", pa.binary())], lambda k, u, h: {record: response(str(k), u, h)})


def derive(df: DataFrame, record: str = "record") -> DataFrame:
    """``df`` with the derivatives of each response record, see ``DERIVED``; columns of these names are replaced."""
    return _mapped(df, [record], DERIVED, derivatives)


def build(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Responses of pages and their derivatives in one pass over the pages, without the html."""

    def both(k, u, h) -> dict:
        made = response(str(k), u, h)
        return derivatives(made) | {"record": made}

    return _mapped(pages, [page_id, url, html], [("record", "binary", pa.binary()), *DERIVED], both, drop=(html,))


def archives(df: DataFrame, columns: tuple[str, ...] = ("metadata", "conversion"), most: int = 32_000_000) -> DataFrame:
    """Archive files of the records: (content binary, n_records), each record a gzip member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def file(members: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary()), pa.array([len(members)], pa.int64())], names=["content", "n_records"])

        members, size = [], 0
        for whole in batches:
            for row in zip(*(column(whole, c) for c in columns), strict=True):
                for r in row:
                    if r is not None:
                        members.append(gzip.compress(r, 6, mtime=0))
                        size += len(members[-1])
                        if size >= most:
                            yield file(members)
                            members, size = [], 0
        if members:
            yield file(members)

    return df.select(*columns).mapInArrow(run, "content binary, n_records bigint")


def scan(files: DataFrame, content: str = "content") -> DataFrame:
    """Every record of archive files (a column of their bytes, gzip members or plain): its type, id and bytes.

    Where a file is damaged its records so far are given, then a row that has the ``problem`` only.
    """

    def read(data: bytes) -> Iterator[tuple]:
        try:
            plain = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
            for h, b in read_records(plain):
                by = dict(h)
                yield by.get("WARC-Type"), by.get("WARC-Record-ID"), write_record(h, b), None
        except (ValueError, EOFError, OSError, zlib.error) as e:
            yield None, None, None, str(e) or "damaged archive"

    kinds = [("warc_type", pa.string()), ("record_id", pa.string()), ("record", pa.binary()), ("problem", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for data in column(whole, content):
                rows = list(read(data or b""))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return files.select(F.col(content)).mapInArrow(run, "warc_type string, record_id string, record binary, problem string")
