"""WARC derivatives: metadata and plain-text conversion records linked to responses.

``read`` parses WARC files (plain or gzipped), ``derive`` makes the linked
records and ``write`` stores records as gzipped WARC files, one for each partition.

For each response, a ``metadata`` record lists as ``application/warc-fields`` the
source's own WARC headers (digests, address, warcinfo id and all others), its HTTP
status and headers, its lengths, and digests made anew; where the source states a
digest in SHA-1, ``source-...-digest-valid`` says whether it holds.  A
``conversion`` record holds the page's text, from the payload with its transfer
and content encodings undone.  Both carry the response's record id in
``WARC-Refers-To``, its target URI and date, and its warcinfo id; digests are
SHA-1 in base 32.  Record ids derive from the response's id and the record's type,
so reruns agree.

``read`` lets Spark's text source cut the files where a record begins, so a record
is a row, a plain file is read by many tasks, and memory is that of one batch of
records.  The stated lengths decide: a piece is read record by record to its end, so
one that holds several gives all of them, and bytes that belong to none are an error.
A block that itself holds a blank line and then ``WARC/1.`` at the start of a line
(an archive in an archive) would be cut there, so ``write`` puts such records in
files below ``whole``, and ``read`` reads these in one piece each.  In files from
elsewhere such a record does not have its stated length and is refused (``whole=True``
reads every file in one piece, which takes twice a file's size in memory).

Defined cases: a null or empty body gives a conversion of length 0; null ids,
urls and dates are left out of the headers; records that are not responses pass
``derive`` by; an unknown charset counts as UTF-8, an unknown or broken encoding
leaves the payload as it is; repeated rows give repeated records; an empty table
gives no rows; other columns are not read and may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.html_main import BLOCKS, tags_of
from gridloom.llm.store import Store

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
#: What the text source cuts files by: the end of a record and the beginning of the next one's version.
BORDER = "\r\n\r\nWARC/1."
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*+>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^<>]*+>")
RECORD = "record_id string, type string, refers_to string, target_uri string, date string, headers array<struct<name:string,value:string>>, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, '|'.join(map(str, parts)))}>"


def plain_text(source: str) -> str:
    """All of a page's visible text: a line for each block, white space made single."""
    out, at = [], 0
    for tag in tags_of(source):
        out += [" ".join(source[at : tag.start].split()) if source[at : tag.start].strip() else " " * (at < tag.start), "\n" if tag.name in BLOCKS or tag.name == "br" else " "]
        at = tag.stop
    out.append(" ".join(source[at:].split()))
    lines = (" ".join(line.split()) for line in entities.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def same_digest(stated: str, data: bytes) -> bool:
    """Whether a stated SHA-1 (base 32 or base 16) is that of the data."""
    value, own = stated.partition(":")[2].strip(), hashlib.sha1(data)
    return value.lower() == own.hexdigest() if len(value) == 40 else value.upper() == base64.b32encode(own.digest()).decode()


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(n.strip(), v.strip()) for n, _, v in (line.partition(":") for line in lines[1:])], body


def undone(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer encoding (chunks) and content encoding (gzip, deflate); as it is where it does not decode."""
    of = {n.lower(): v.lower().strip() for n, v in headers}
    if "chunked" in of.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            try:
                size = int(payload[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                payload = b"".join(out)
                break
            out.append(payload[end + 2 : end + 2 + size])
            at = end + 2 + size + 2
    for name in reversed([e.strip() for e in of.get("content-encoding", "").split(",") if e.strip()]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name, ()):
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:
                continue
    return payload


def derivatives(rid: str | None, uri: str | None, date: str | None, own_headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    status, headers, payload = split_http(block)
    kind = next((v for n, v in headers if n.lower() == "content-type"), "text/html")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    raw = undone(payload, headers)
    try:
        body = raw.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        body = raw.decode("utf-8", "replace")
    text = (plain_text(body) if "html" in kind.lower() else body).encode("utf-8", "replace")
    fields = [(f"source-{n.lower()}", v) for n, v in own_headers]
    fields += [("http-status", status)] * bool(status) + [(f"http-header-{n.lower()}", v) for n, v in headers]
    fields += [("source-payload-length", str(len(payload))), ("source-payload-digest", digest(payload)), ("source-block-digest", digest(block))]
    stated = {n.lower(): v for n, v in own_headers}
    for name, data in (("payload", payload), ("block", block)):
        if (old := stated.get(f"warc-{name}-digest", "")).lower().startswith("sha1:"):
            fields.append((f"source-{name}-digest-valid", str(same_digest(old, data)).lower()))
    info = "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in fields).encode("utf-8", "replace")
    out = []
    for name, content_type, data in (("metadata", "application/warc-fields", info), ("conversion", "text/plain; charset=utf-8", text)):
        own = record_id(rid, uri, date, name)
        head = [("WARC-Type", name), ("WARC-Record-ID", own), ("WARC-Refers-To", rid), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Warcinfo-ID", stated.get("warc-warcinfo-id")), ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type), ("Content-Length", str(len(data)))]
        out.append({"record_id": own, "type": name, "refers_to": rid, "target_uri": uri, "date": date, "headers": [{"name": n, "value": v} for n, v in head if v is not None], "block": data})
    return out


_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary())])


def derive(records: DataFrame) -> DataFrame:
    """Two linked records for each ``response`` of ``records(record_id, type, target_uri, date, headers, block)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [
                    d for r in batch.slice(at, 64).to_pylist()
                    for d in derivatives(r["record_id"], r["target_uri"], r["date"], [(h["name"], h["value"] or "") for h in r["headers"] or () if h and h["name"]], r["block"] or b"")
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return records.where("type = 'response'").select("record_id", "target_uri", "date", "headers", "block").mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of ``pages(page_id, url, html)``: the html below an HTTP head; ids derive from id and url."""
    key = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))).cast("binary"))
    shape = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    url = F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20]", "%20")  # a header is one line
    made = pages.select(shape.alias("record_id"), url.alias("target_uri"), body.alias("body"), F.concat(head, body).cast("binary").alias("block"))
    entry = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    sha = lambda c: F.concat(F.lit("sha1:"), F.upper(F.sha1(c)))  # noqa: E731  written in base 16, which the format allows too
    headers = F.array(
        entry("WARC-Type", F.lit("response")), entry("WARC-Record-ID", F.col("record_id")), entry("WARC-Target-URI", F.col("target_uri")), entry("WARC-Date", F.lit(date)),
        entry("WARC-Payload-Digest", sha(F.col("body").cast("binary"))), entry("Content-Type", F.lit("application/http; msgtype=response")), entry("Content-Length", F.octet_length("block")),
    )
    headers = F.filter(headers, lambda h: h["value"].isNotNull())
    return made.select("record_id", F.lit("response").alias("type"), F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"), headers.alias("headers"), "block")


def parse(data: bytes, strict: bool = False) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped; with ``strict``, a block that is cut short and what stands between records are errors."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if strict and line.strip():
                raise ValueError(f"bytes that belong to no record: {line[:80]!r}; an archive in an archive, or a damaged file; read with whole=True")
            continue
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.append((name.strip(), value.strip()))
        of = {n.lower(): v for n, v in head}
        block = stream.read(stated := int(of.get("content-length", 0)))
        if strict and len(block) < stated:
            raise ValueError(f"record {of.get('warc-record-id')} has {len(block)} of {stated} bytes: an archive in an archive, or a damaged file; read with whole=True")
        yield {"record_id": of.get("warc-record-id"), "type": of.get("warc-type"), "refers_to": of.get("warc-refers-to"), "target_uri": of.get("warc-target-uri"), "date": of.get("warc-date"), "headers": [{"name": n, "value": v} for n, v in head], "block": block}


def _cut(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", BORDER).text(path).select(F.col("value").cast("binary").alias("value"))


def _records(data: bytes) -> Iterator[dict]:
    """The records of a piece between two borders: one, or more where the cutting missed a border; the cut took the version's beginning, except from a file's first record."""
    return parse(data if data.startswith(b"WARC/") else b"WARC/1." + data, strict=True) if data.strip() else iter(())


def _apart(spark: SparkSession, path: str) -> str | None:
    """Where ``write`` put records whose blocks hold a border, if this folder has such files."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/whole")
    return str(folder) if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else None


def derive_files(spark: SparkSession, path: str) -> DataFrame:
    """``derive(read(spark, path))`` in one pass, in which no record goes back to Spark between the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for raw in batch.column(0):
                for r in _records(raw.as_buffer().to_pybytes()):
                    if r["type"] == "response":
                        out += derivatives(r["record_id"], r["target_uri"], r["date"], [(h["name"], h["value"]) for h in r["headers"] if h["name"]], r["block"])
                        size += len(r["block"])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    made = _cut(spark, path).mapInArrow(run, RECORD)
    return made.unionByName(derive(read(spark, apart, whole=True))) if (apart := _apart(spark, path)) else made


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The records of all WARC files below ``path``; ``whole`` reads each file in one piece."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part, size = [], 0
                for r in parse(data):
                    part.append(r)
                    size += len(r["block"])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(part, schema=_SCHEMA)
                        part, size = [], 0
                yield pa.RecordBatch.from_pylist(part, schema=_SCHEMA)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for raw in batch.column(0) for r in _records(raw.as_buffer().to_pybytes())], schema=_SCHEMA)

    if whole:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(files, RECORD)
    made = _cut(spark, path).mapInArrow(cut, RECORD)
    return made.unionByName(read(spark, apart, whole=True)) if (apart := _apart(spark, path)) else made


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Store records as WARC files below ``path`` (gzipped, or plain with ``none``), their headers and blocks byte by byte.

    Spark's text writer does it, so tasks commit atomically and may be retried; a record's end is the line separator.
    """
    head = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    whole = F.concat(F.lit("WARC/1.1\r\n").cast("binary"), head.cast("binary"), F.lit("\r\n").cast("binary"), F.coalesce("block", F.lit("").cast("binary")))
    holds = F.coalesce(F.contains(F.col("block"), F.lit(BORDER).cast("binary")), F.lit(False))
    for where, folder in ((~holds, path), (holds, f"{path}/whole")):
        records.where(where).select(whole.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(folder)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as responses, written to WARC files, read from them again, and their derivatives."""
    files = f"{Store(spark, 'warc').base}/responses"
    write(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), files, "none")  # plain files can be split
    made = derive_files(spark, files)
    value = lambda n: F.element_at(F.filter("headers", lambda h: h["name"] == n), 1)["value"].alias(n.lower().replace("-", "_"))
    return made.select("record_id", "type", "refers_to", "target_uri", "date", value("Content-Type"), value("Content-Length"), value("WARC-Block-Digest"), F.decode("block", "UTF-8").alias("content"))
