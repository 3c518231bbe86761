"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

For every response record the builder writes a `metadata` record (fields of the response, counts and
outlinks) and a `conversion` record (the page's text). Both name the response in WARC-Refers-To, keep its
target URI, date and payload digest and have digests of their own block; all of the response's WARC headers
stand in the metadata record's block as source-<name> fields. Record ids are name-based UUIDs of the
response's id and the record type, so a repeated task writes the same file.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

VERSION = "WARC/1.1"
#: Compression level of the records.
LEVEL = 3
#: Records without a date of their own carry this one.
NO_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 9562
#: Elements that end lines, and those whose content is not shown.
_BREAKING = frozenset("address article aside blockquote br div dl dt dd footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul title".split())
_UNSEEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}
_SPECIAL = _BREAKING | set(_UNSEEN) | {"a"}
_MARKUP = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?([a-zA-Z][a-zA-Z0-9]*)")
_HREF = re.compile(r"""\bhref\s*=\s*(?:(["'])|([^\s>"'][^\s>]*))""", re.I)
_TITLE_END = re.compile("</title", re.I)
_LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def unescaped(text: str) -> str:
    """text with its entities read; a number of more digits than any code point has is U+FFFD."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text))


def parse_page(page: str) -> tuple[str, str, list[str]]:
    """(title, text, targets of anchors) of a page, in one pass.

    Comments, scripts, styles and the like are not shown; block elements end lines, other tags go, entities are
    read and white space collapses. A tag ends at the next `>`, or after it where that stands in an anchor's quoted
    target. What isn't ended goes to the page's end. Every search starts where the last ended, and one that
    found nothing is not made again, so the time is proportional to the page, whatever stands in it.
    """
    out: list[str] = []
    targets: list[str] = []
    title, at, n = None, 0, len(page)
    closed = {'"': True, "'": True}  # whether a quote may still come
    search, find = _MARKUP.search, page.find
    while found := search(page, at):
        start, after = found.span()
        if start > at:
            out.append(page[at:start])
        name = found[1]
        if name is None and (mark := "-->" if found[0] == "<!--" else "]]>" if found[0] == "<![CDATA[" else None):
            end = find(mark, after)
            out.append(" ")
            at = end + len(mark) if end >= 0 else n
            continue
        end = find(">", after)
        at = end + 1 if end >= 0 else n
        if name is None or (name := name.lower()) not in _SPECIAL:
            continue
        if name in _BREAKING:
            out.append("\n")
        if page[start + 1] == "/":
            continue
        if name == "a" and (href := _HREF.search(page, after, at)):
            target = href[2]
            if (quote := href[1]) and closed[quote]:
                stop = find(quote, href.end())
                closed[quote] = stop >= 0
                if stop >= 0:
                    target = page[href.end():stop]
                    if stop >= at:
                        end = find(">", stop)
                        at = end + 1 if end >= 0 else n
            if target is not None:
                targets.append(unescaped(target))
        elif name in _UNSEEN:
            stop = _UNSEEN[name].search(page, at)
            out.append(" ")
            at = stop.end() if stop else n
        elif name == "title" and title is None:
            stop = _TITLE_END.search(page, at)
            title = page[at:stop.start()] if stop else ""
    out.append(page[at:])
    lines = (" ".join(x.split()) for x in unescaped("".join(out)).split("\n"))
    return " ".join(unescaped(title or "").split()), "\n".join(line for line in lines if line), targets


def plain_text(page: str) -> str:
    """What a page shows as text."""
    return parse_page(page)[1]


def encode_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, as a gzip member of its own; header values lose line breaks."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def response_block(page: str) -> bytes:
    body = page.encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body


def response(url: str, page: str, name: str, date: str = NO_DATE, more: Iterable[tuple[str, str]] = ()) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of a response record for a page; headers of `more` that it has already are left as they are."""
    block = response_block(page)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(f"response:{name}")), ("WARC-Date", date), ("WARC-Target-URI", url),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(page.encode())), ("WARC-Block-Digest", digest(block))]
    own = {k.lower() for k, _ in headers} | {"content-length"}
    return headers + [(k, v) for k, v in more if k.lower() not in own], block


def derive(headers: dict[str, str] | list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record; as pairs, its headers may repeat."""
    every = list(headers.items()) if isinstance(headers, dict) else headers
    headers = dict(every)
    head, _, body = block.partition(b"\r\n\r\n")
    status, *fields = head.decode("utf-8", "replace").split("\r\n")
    page = body.decode("utf-8", "replace")
    source = headers["WARC-Record-ID"]
    title, text, targets = parse_page(page)
    text = text.encode()
    shared = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", headers.get("WARC-Target-URI", "")), ("WARC-Refers-To-Date", headers.get("WARC-Date", NO_DATE)),
              ("WARC-Target-URI", headers.get("WARC-Target-URI", "")), ("WARC-Date", headers.get("WARC-Date", NO_DATE)), ("WARC-Source-Payload-Digest", headers.get("WARC-Payload-Digest") or digest(body))]
    conversion = record_id(f"conversion:{source}")
    out = [f"http-status: {status}", *(f"http-{f}" for f in fields), *(f"source-{k}: {' '.join(v.split())}" for k, v in every), f"title: {title}", f"text-bytes: {len(text)}", f"conversion: {conversion}", *(f"outlink: {' '.join(u.split())}" for u in targets)]
    meta = "\r\n".join(out).encode()
    made = []
    for kind, name, media, block in (("metadata", record_id(f"metadata:{source}"), "application/warc-fields", meta), ("conversion", conversion, "text/plain; charset=utf-8", text)):
        made.append(([("WARC-Type", kind), ("WARC-Record-ID", name), *shared, ("Content-Type", media), ("WARC-Block-Digest", digest(block))], block))
    return made


def source_headers(meta: bytes) -> str:
    """The response's headers from the block of its metadata record, a line each."""
    return "\n".join(x.removeprefix("source-") for x in meta.decode().split("\r\n") if x.startswith("source-"))


def build_derivatives(pages: DataFrame, path: str | None = None) -> str:
    """Write pages (page_id, url, html) as response records and their derivatives; returns the path.

    One file a task: each response is followed by its two derivatives. Null url or html count as empty;
    a column warc_headers (map of strings), if there is one, gives more headers of a response and its
    WARC-Date. Rows are told apart by all of these, so equal rows give equal records. Beside the files
    stands a Parquet table `records` of (file, records).
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        (F.col("warc_headers") if "warc_headers" in pages.columns else F.lit(None)).cast("map<string,string>").alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, sink = TaskContext.get().partitionId(), 0, None
        place, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        draft, final = f"{folder}/.{part:06d}-{uuid.uuid4().hex}", f"{folder}/part-{part:06d}.warc.gz"
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, page, more = (batch.column(k)[i].as_py() for k in range(4))
                more = sorted((k, v) for k, v in more or () if v is not None)
                if sink is None:
                    place.create_dir(folder, recursive=True)
                    sink = place.open_output_stream(draft)
                name = f"{page_id}\n{url}\n{hashlib.sha256(page.encode()).hexdigest()}" + (f"\n{more}" if more else "")
                headers, block = response(url, page, name, next((v for k, v in more if k.lower() == "warc-date"), NO_DATE), more)
                for h, b in [(headers, block), *derive(headers, block)]:
                    sink.write(encode_record(h, b))
                    n += 1
        if sink is not None:
            sink.close()
            place.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([final.rsplit("/", 1)[1]]), pa.array([n])], names=["file", "records"])

    rows.mapInArrow(run, "file string, records long").write.parquet(f"{path}/records")
    return path


def read_derivatives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files at path, read back: type, record_id, refers_to, target_uri, date,
    content_type, payload_digest (of the source), block_digest, digest_ok, content_length, block_sha256 and,
    of metadata records, source_headers: the response's headers, a `name: value` line each."""
    files = spark.read.schema("file string, records long").parquet(f"{path}/records").select("file").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, digest_ok boolean, content_length long, block_sha256 string, source_headers string"

    def members(source) -> Iterator[tuple[dict[str, str], bytes]]:
        stream = gzip.GzipFile(fileobj=source)
        reader = io.BufferedReader(stream, 1 << 20)
        while line := reader.readline():
            if not line.strip():
                continue
            headers: dict[str, str] = {}
            while (line := reader.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name.strip()] = value.strip()
            yield headers, reader.read(int(headers["Content-Length"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[list] = []
                with place.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    for h, b in members(source):
                        rows.append([h.get("WARC-Type"), h.get("WARC-Record-ID"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Date"), h.get("Content-Type"),
                                     h.get("WARC-Source-Payload-Digest") or h.get("WARC-Payload-Digest"), h.get("WARC-Block-Digest"), h.get("WARC-Block-Digest") == digest(b), len(b), hashlib.sha256(b).hexdigest(), source_headers(b) if h.get("WARC-Type") == "metadata" else None])
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])

    return files.mapInArrow(run, schema)
