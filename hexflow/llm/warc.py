"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Every response record gives one ``metadata`` record (application/warc-fields: HTTP status, content
type, title, outgoing links, times) and one ``conversion`` record (text/plain).  Both name the
response in WARC-Refers-To together with its target URI and date, keep the WARC-Record-ID chain
and the source's HTTP headers, and carry SHA-1 block and payload digests of their own; the
response's payload digest is recomputed and compared with the one it states.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow.llm.html_extract import tokens
from hexflow.llm.scratch import Scratch
from hexflow.llm.text import slices
from hexflow.session import ship_package

VERSION = b"WARC/1.1"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:hexflow:warc")
# Elements whose content is no text, and elements that end a line.
_HIDDEN = frozenset("noscript template head svg".split())
_LINES = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul".split())
_HREF = re.compile(r"(?<![^\s\"'/])href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_BLANK = re.compile("[ \\t\\r\\f\\v\\xa0]+")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that follows from its parts, so reruns and recomputed tasks agree."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(map(str, parts)))}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record: version, headers, blank line, block, two line ends."""
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {_one_line(v)}".encode() for k, v in headers if v is not None]
    lines += [f"WARC-Block-Digest: {sha1(block)}".encode(), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.decode().partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest[: int(headers["content-length"])]


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an application/http block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def page_parts(page: str) -> tuple[str, str | None, list[str]]:
    """(visible text, title, links) of a page: one line a block, lines without text left out."""
    text, links, title, hidden = [], [], None, []
    for kind, value, attrs in tokens(page):
        if kind == "text":
            if not hidden:
                text.append(value)
        elif kind == "raw":
            if value == "title" and title is None:
                title = html.unescape(attrs)
            if value in ("title", "textarea", "xmp") and not hidden:
                text.append(f"\n{attrs}\n")
        elif value in _HIDDEN:
            if kind == "open":
                hidden.append(value)
            elif value in hidden:
                del hidden[hidden.index(value) :]
        elif value in _LINES:
            if not hidden:
                text.append("\n")
        if kind == "open" and value == "a" and "=" in attrs:
            found = _HREF.search(attrs)
            if found:
                links.append(html.unescape(found[1].strip("\"'")))
    lines = _BLANK.sub(" ", html.unescape("".join(text))).split("\n")
    return "\n".join(x for x in map(str.strip, lines) if x), title, links


def response_record(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    payload = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [
        ("WARC-Record-ID", record_id("response", page_id, url, hashlib.sha1(payload).hexdigest())),
        ("WARC-Target-URI", url or f"urn:page:{page_id}"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", sha1(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return record("response", headers, http)


def derive(raw: bytes) -> tuple[bytes, bytes, dict]:
    """(metadata record, conversion record, their main values) of a response record."""
    source, block = parse(raw)
    status, http, payload = http_parts(block)
    content_type = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = next((x.split("=", 1)[1].strip(" \"'") for x in content_type.split(";")[1:] if x.strip().lower().startswith("charset=")), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    sound = source.get("warc-payload-digest") in (None, sha1(payload))
    text, title, links = page_parts(page)
    text = text.encode()
    fields = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http), ("source-payload-digest", sha1(payload)), ("source-digest-matches", str(sound).lower())]
    fields += [("title", title)] if title is not None else []
    fields += [("outlink", link) for link in links]
    fields_block = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields).encode()
    origin = source["warc-record-id"]
    shared = [("WARC-Target-URI", source.get("warc-target-uri")), ("WARC-Date", source.get("warc-date")), ("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", source.get("warc-target-uri")), ("WARC-Refers-To-Date", source.get("warc-date"))]
    meta_id, conv_id = record_id("metadata", origin), record_id("conversion", origin)
    meta = record("metadata", [("WARC-Record-ID", meta_id), *shared, ("WARC-Concurrent-To", conv_id), ("Content-Type", "application/warc-fields")], fields_block)
    conv = record("conversion", [("WARC-Record-ID", conv_id), *shared, ("WARC-Payload-Digest", sha1(text)), ("WARC-Source-Payload-Digest", sha1(payload)), ("Content-Type", "text/plain; charset=utf-8")], text)
    values = {
        "target_uri": source.get("warc-target-uri"), "response_id": origin, "metadata_id": meta_id, "conversion_id": conv_id, "source_payload_digest": sha1(payload), "source_digest_ok": sound,
        "metadata_digest": sha1(fields_block), "conversion_digest": sha1(text), "n_links": len(links), "text_bytes": len(text),
    }
    return meta, conv, values


_VALUES = "target_uri string, response_id string, metadata_id string, conversion_id string, source_payload_digest string, source_digest_ok boolean, metadata_digest string, conversion_digest string, n_links long, text_bytes long"
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, warc): a response record for every row of ``pages`` (page_id, url, html).

    Null html is an empty payload; a null url gives the target urn:page:<page_id>.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([response_record(*r, date) for r in rows], pa.binary())], ["page_id", "warc"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, warc binary")


def derivatives(records: DataFrame) -> DataFrame:
    """(page_id, derived values, metadata, conversion) of every row of ``records`` (page_id, warc).

    ``metadata`` and ``conversion`` are gzip members, so any concatenation of them is a WARC file.
    Repeated rows give equal records with equal ids; an empty table gives an empty result.
    """
    ship_package(records.sparkSession)
    names = [x.split() for x in _VALUES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "warc", 4 << 20):
                made = [derive(raw) for raw in part.column("warc").to_pylist()]
                values = [pa.array([v[n] for *_, v in made], _KINDS[k]) for n, k in names]
                members = [pa.array([gzip.compress(m[i], 6, mtime=0) for m in made], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *values, *members], ["page_id", *(n for n, _ in names), "metadata", "conversion"])

    return records.select("page_id", "warc").mapInArrow(run, f"page_id long, {_VALUES}, metadata binary, conversion binary")


def write_files(records: DataFrame, path: str, *columns: str) -> None:
    """Writes records (columns of gzip members or plain records) as plain WARC files, one a task; empty tasks write none.

    Only Spark's text writer touches the store, its line end being a record's; a block that is no UTF-8 is an error.
    """
    ship_package(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [gzip.decompress(r) if r[:2] == b"\x1f\x8b" else r for c in columns for r in batch.column(c).to_pylist() if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r.removesuffix(b"\r\n\r\n").decode() for r in plain], pa.string())], ["value"])

    records.select(*columns).mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").text(path)


def split_records(raw: bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or of gzip members; a file that ends inside a record is an error."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        sizes = [line.partition(b":")[2] for line in raw[at:head].split(b"\r\n") if line[:15].lower() == b"content-length:"]
        if head < 0 or not raw.startswith(b"WARC/", at) or not sizes or (end := head + 4 + int(sizes[0])) > len(raw):
            raise ValueError("not a whole WARC record")
        yield raw[at:end] + b"\r\n\r\n"
        at = end
        while raw.startswith(b"\r\n", at):
            at += 2


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, warc): every record of the WARC files below ``path``; a file must fit in a binary cell (2 GB)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path"), batch.column("content"), strict=True):
                records = list(split_records(raw.as_py()))
                for a in range(0, len(records), 1000):
                    some = records[a : a + 1000]
                    kinds = [parse(r)[0].get("warc-type") for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(some), pa.string()), pa.array(kinds, pa.string()), pa.array(some, pa.binary())], ["file", "type", "warc"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "file string, type string, warc binary")


def write_derivatives(pages: DataFrame) -> str:
    """Writes the derivatives of ``pages`` as a table of gzip members; returns its folder."""
    scratch = Scratch(pages.sparkSession, "warc")
    scratch.save(derivatives(responses(pages)), "derivatives")
    return scratch.path("derivatives")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, derived values, n_chars) with ids, references and digests read from the records themselves."""
    ship_package(spark)
    names = ["page_id", "target_uri", "response_id", "metadata_id", "conversion_id", "metadata_refers_to", "conversion_refers_to", "source_payload_digest", "metadata_digest", "conversion_digest", "n_links", "text_bytes", "n_chars"]
    kinds = [pa.int64(), *[pa.string()] * 9, *[pa.int64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, response, meta, conv in zip(*(batch.column(c).to_pylist() for c in ("page_id", "response_id", "metadata", "conversion")), strict=True):
                (m, fields), (c, text) = parse(gzip.decompress(meta)), parse(gzip.decompress(conv))
                if m["warc-block-digest"] != sha1(fields) or c["warc-block-digest"] != sha1(text):
                    raise ValueError(f"page {page}: a record is damaged")
                digest = next(x.split(b": ", 1)[1].decode() for x in fields.split(b"\r\n") if x.startswith(b"source-payload-digest: "))
                rows.append((page, c["warc-target-uri"], response, m["warc-record-id"], c["warc-record-id"], m["warc-refers-to"], c["warc-refers-to"], digest, sha1(fields), c["warc-payload-digest"], fields.count(b"\r\noutlink: "), len(text), len(text.decode())))
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], names)

    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    return spark.read.parquet(path).select("page_id", "response_id", F.col("metadata"), F.col("conversion")).mapInArrow(run, schema)


def build(pages: DataFrame) -> DataFrame:
    """Writes the derivatives of ``pages`` (page_id, url, html) and reads them back: one row a page.

    Null or empty html gives records with an empty text; rows with a null url refer to
    urn:page:<page_id>; extra columns are ignored.
    """
    return read_back(pages.sparkSession, write_derivatives(pages))
