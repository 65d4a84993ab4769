"""WARC derivatives: linked metadata and plain-text conversion records for responses.

A response gives two records. Both point to it by WARC-Refers-To and keep its
target URI, date, HTTP headers and payload digest; each has its own record id and
the digest of its own block. ``metadata`` holds the title, language, links and
source headers as ``application/warc-fields``; ``conversion`` the text without
markup. Digests are SHA-1 in base 32; record ids derive from what they name, so
that a job that runs again writes the same.

``write_warc`` writes records as WARC files, one gzip member for each record, and
``read_warc`` reads them back. A null body is empty; a null URI leaves the header
out, also from the digest of the record id. Repeated rows give repeated records.
An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.llm.common import arrow_batch, open_store, ready

HEADERS = "Content-Type: text/html; charset=utf-8"
RECORDS = "source_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_headers string, payload_digest string, block_digest string, content_length long, block string"

_GONE = re.compile(r"<!--|<(script|style|noscript|template|head)\b[^>]*>|<!\w[^>]*>", re.I)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "head")}
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|main|aside|blockquote|pre|hr|dl|dt|dd|form|figure)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _ANCHOR = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"<a\b[^>]*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def tagged(page: str) -> tuple[str, str]:
    """The page up to its last ``>``, where every tag that begins also ends, and the rest, which holds no tag."""
    cut = page.rfind(">") + 1
    return page[:cut], page[cut:]


def visible(page: str) -> str:
    """The page without comments, scripts, styles, templates and head, a blank for each. One pass: what isn't closed is looked for once."""
    page, rest = tagged(page)
    out, at, open_ended = [], 0, {}
    while hit := _GONE.search(page, at):
        out.append(page[at : hit.start()])
        name = (hit[1] or "").lower()
        if hit[0] == "<!--":
            end = page.find("-->", hit.end())
            at = len(page) if end < 0 else end + 3
        elif not name or name in open_ended:
            at = hit.end()
        else:
            end = _CLOSED[name].search(page, hit.end())
            if end:
                at = end.end()
            elif name == "head":  # its tags go, its text stays
                open_ended[name], at = True, hit.end()
            else:
                return " ".join(out) + " "
    return " ".join([*out, page[at:] + rest])


def plain_text(page: str, shown: str | None = None) -> str:
    """Text outside markup, scripts, styles and comments (``shown``: the visible page, where it is known); a line for each block."""
    marked, rest = tagged(visible(page) if shown is None else shown)
    text = _TAG.sub("", _BREAK.sub("\n", marked)) + rest
    return _LINES.sub("\n", _BLANKS.sub(" ", entities.unescape(text))).strip()


def one_line(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def metadata_fields(page: str, headers: str, shown: str | None = None) -> str:
    """``name: value`` lines: the first title, the first html tag's language, links in their order, source headers."""
    marked = tagged(page)[0]
    title, lines = _TITLE.search(marked), []
    if title and (end := _TITLE_END.search(marked, title.end())):
        lines.append(f"title: {one_line(marked[title.end() : end.start()])}")
    if (tag := _HTML.search(marked)) and (lang := _LANG.search(tag[0])):
        lines.append(f"language: {lang[1]}")
    for tag in _ANCHOR.finditer(tagged(visible(page) if shown is None else shown)[0]):
        if href := _HREF.search(tag[0]):
            lines.append(f"outlink: {one_line(href[1] or href[2] or href[3] or '')}")
    lines += [f"source-header: {one_line(h)}" for h in headers.splitlines() if h.strip()]
    return "".join(f"{x}\r\n" for x in lines)


def responses_from_pages(pages: DataFrame, warc_date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages as responses: source_id, record_id (null: derived), target_uri, warc_date, headers, body."""
    return pages.select(F.col("page_id").cast("long").alias("source_id"), F.lit(None).cast("string").alias("record_id"), F.col("url").alias("target_uri"), F.lit(warc_date).alias("warc_date"), F.lit(HEADERS).alias("headers"), F.col("html").alias("body"))


def build_derivatives(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response."""

    names = ["source_id", "record_id", "target_uri", "warc_date", "headers", "body"]

    def build(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for source_id, given, uri, date, headers, body in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                body, headers = body or "", headers or ""
                shown = visible(body)
                payload = digest(body.encode("utf-8", "replace"))
                source = given or record_id("response", str(source_id), uri or "", payload)
                for kind, content, block in (("metadata", "application/warc-fields", metadata_fields(body, headers, shown)), ("conversion", "text/plain", plain_text(body, shown))):
                    data = block.encode("utf-8", "replace")
                    rows.append((source_id, kind, record_id(kind, source), source, uri, date, content, headers, payload, digest(data), len(data), block))
            yield arrow_batch(RECORDS, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 12)

    ready(responses.sparkSession)
    return responses.select(F.col("source_id").cast("long").alias("source_id"), *names[1:]).mapInArrow(build, RECORDS)


_FIELDS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "warc_date", "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type"}


def serialise(record: dict) -> bytes:
    """One WARC 1.1 record."""
    block = record["block"].encode("utf-8", "replace")
    fields = [(k, record[v]) for k, v in _FIELDS.items()]
    fields += [("WARC-Source-Header", h) for h in (record["source_headers"] or "").splitlines()] + [("WARC-Source-ID", record["source_id"])]
    head = "".join(f"{k}: {one_line(str(v)) if k != 'WARC-Target-URI' else ''.join(str(v).splitlines())}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write a file for each partition; returns file and number of records. A task that runs again replaces its file."""

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        store, root = open_store(folder)
        name, n, out = f"{root}/derived-{TaskContext.get().partitionId():06d}.warc.gz", 0, None
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own, compression=None)
            for record in batch.to_pylist():
                out.write(gzip.compress(serialise(record), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            store.move(own, name)
            yield arrow_batch("file string, n long", [[name], [n]])

    open_store(folder)  # fails before any task does
    return records.mapInArrow(write, "file string, n long")


def parse_records(data: bytes) -> Iterator[dict[str, object]]:
    """The records of a WARC file's decompressed bytes: header fields by lower-case name, repeated ones joined by line breaks, and ``block``."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        fields: dict[str, object] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            known = fields.get(name.lower())
            fields[name.lower()] = value if known is None else f"{known}\n{value}"
        size = int(fields["content-length"])
        fields["block"] = data[end + 4 : end + 4 + size]
        yield fields
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path``, one file at a time in a task."""

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for f in parse_records(gzip.decompress(content)):
                    source = f.get("warc-source-id")
                    rows.append((None if source is None else int(source), f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), f.get("content-type"), f.get("warc-source-header", ""), f.get("warc-payload-digest"), f.get("warc-block-digest"), len(f["block"]), f["block"].decode("utf-8", "replace")))
                yield arrow_batch(RECORDS, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 12)

    return ready(spark).read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInArrow(read, RECORDS)
