"""WARC 1.1 records, and derivatives of responses: a metadata and a plain-text conversion record for each, linked to it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import calm
from .html import lines

END = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Field for the id of a page that a response was made of.
PAGE = "X-Page-ID"
#: Bytes that are decompressed at once.
MEMBER = 1 << 20
NUMBER = re.compile(r"-?\d{1,18}")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version line, named fields, blank line, block, two blank lines. Line ends in a value become blanks."""
    fields = [f"{k}: {' '.join(v.split(chr(10))).replace(chr(13), ' ')}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return END.join([b"WARC/1.1", *(x.encode("utf-8", "surrogatepass") for x in fields), b"", block, b"", b""])


Fields = list[tuple[str, str]]


def fields(data: bytes) -> Fields:
    """Named fields of a header block in their order, repeated ones too; a line that begins with a blank goes on with the last."""
    out: Fields = []
    for line in data.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}".strip())
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def first(named: Fields, name: str, default: str = "") -> str:
    """The first value of a name, whatever its case."""
    return next((v for k, v in named if k.lower() == name), default)


def unzipped(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The chunks of a file that may be gzip members one after another, decompressed MEMBER bytes at a time; as they are if it isn't. A broken
    member ends the file."""
    member, head = None, b""
    for chunk in chunks:
        if member is None and head is not None:
            head += chunk
            if len(head) < 2:
                continue
            chunk, head = head, None
            if chunk[:2] == b"\x1f\x8b":
                member = zlib.decompressobj(31)
        if member is None:
            yield chunk
            continue
        while chunk:
            try:
                yield member.decompress(chunk, MEMBER)
            except zlib.error:
                return
            chunk = member.unconsumed_tail
            if member.eof:
                chunk, member = member.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
    if head:
        yield head


def parse(data: bytes | Iterable[bytes]) -> Iterator[tuple[Fields, bytes]]:
    """Fields and block of each record of a file (its bytes, or chunks of them), plain or of gzip members; a record at a time is held.

    What follows a broken record up to the next version line is passed over. A record without a length ends before the next version line
    after a blank line. A block that ends early is given as far as it goes.
    """
    held = bytearray()
    for chunk in _then_none(unzipped(_chunks(pa.scalar(data, pa.binary())) if isinstance(data, bytes) else data)):
        held += chunk or b""
        while True:
            at = held.find(b"WARC/")
            if at < 0:
                del held[: max(0, len(held) - 4)]
                break
            line = held.find(b"\n", at)
            stop = held.find(b"\r\n\r\n", at)
            bare = held.find(b"\n\n", at, stop if stop >= 0 else len(held))
            stop = bare + 2 if bare >= 0 else stop + 4 if stop >= 0 else -1
            if line < 0 or stop < 0:
                del held[:at]
                break
            named = fields(bytes(held[line + 1 : stop]))
            length = first(named, "content-length")
            if length.isdigit():
                end = stop + int(length)
            else:
                end = min((x for s in (b"\r\n\r\nWARC/", b"\n\nWARC/") if (x := held.find(s, stop)) >= 0), default=len(held) + 1)
            if end > len(held) and chunk is not None:
                break
            yield named, bytes(held[stop:end])
            del held[: min(end, len(held))]


def _then_none(chunks: Iterable[bytes]) -> Iterator[bytes | None]:
    yield from chunks
    yield None


def identifier(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(of))}>"


def response(page_id: int | None, url: str, page: str, date: str = DATE) -> bytes:
    """A response record for a page of the table: its id follows from page id, URL and content; the page id is in a field of its own."""
    body = page.encode("utf-8", "surrogatepass")
    block = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(body)).encode(), b"", body])
    return record(
        [
            *[("WARC-Type", "response"), ("WARC-Record-ID", identifier(str(page_id), url, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response")],
            *[("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), *([(PAGE, str(page_id))] if page_id is not None else [])],
        ],
        block,
    )


def whole_chunks(data: bytes) -> bytes | None:
    """A body without its chunked transfer coding, as far as it goes; null if it isn't in chunks."""
    out, at = [], 0
    while True:
        end = data.find(b"\n", at)
        size = data[at : max(at, end)].split(b";")[0].strip()
        try:
            n = int(size, 16) if end >= 0 else 0
        except ValueError:
            return b"".join(out) if out else None
        if not n:
            return b"".join(out) if out or size == b"0" else None
        out.append(data[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] == b"\n"


def decoded(payload: bytes, headers: Fields) -> bytes | None:
    """The content of a body whose transfer and content codings are undone, as far as it can be read; null if a coding isn't known."""
    if "chunked" in first(headers, "transfer-encoding").lower() and (body := whole_chunks(payload)) is not None:
        payload = body
    for coding in reversed([c.strip().lower() for k, v in headers if k.lower() == "content-encoding" for c in v.split(",")]):
        if coding in ("", "identity"):
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            return None
        raw = coding == "deflate" and not (len(payload) > 1 and payload[0] & 15 == 8 and int.from_bytes(payload[:2], "big") % 31 == 0)
        reader, out = zlib.decompressobj(-15 if raw else 47), []
        try:
            for at in range(0, len(payload), 1 << 16):
                out.append(reader.decompress(payload[at : at + (1 << 16)]))
        except zlib.error:
            # Crawlers may keep a header of a coding that they have undone.
            if not out and coding != "deflate" and payload[:2] != b"\x1f\x8b":
                continue
        payload = b"".join(out)
    return payload


def text_of(payload: bytes | None, kind: str) -> str:
    """Plain text of a content: all lines of a page in order, other texts as they are, nothing for other kinds."""
    if payload is None:
        return ""
    charset = kind.lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        text = payload.decode(charset, "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    if "html" in kind.lower() or not kind:
        return "\n".join(t for _, t in lines(text))
    return text if kind.lower().startswith("text/") else ""


def derive(named: Fields, block: bytes) -> list[tuple[Fields, bytes, bytes]]:
    """Fields, block and whole record of the metadata and the conversion of a response; none for other records.

    Both refer to the response by its id, and keep its date, URI, payload digest (taken anew where it has none) and the records that it
    names as concurrent. The metadata's block has the source's status, all its HTTP headers in their order, and digests; a digest that
    doesn't fit the payload (as it is, or without its chunks) is told there. The conversion has the text without codings.
    """
    if first(named, "warc-type").lower() != "response":
        return []
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        head, payload = b"", block
    status, _, rest = head.partition(b"\n")
    source, taken = fields(rest), {digest(payload)}
    if "chunked" in first(source, "transfer-encoding").lower() and (body := whole_chunks(payload)) is not None:
        taken.add(digest(body))
    given, content = first(named, "warc-payload-digest"), decoded(payload, source)
    kept, refers = given or digest(payload), first(named, "warc-record-id")
    valid = "unknown" if given and not given.lower().startswith("sha1:") else str(not given or given in taken).lower()
    inform = [("http-status", status.decode("utf-8", "replace").strip()), *((f"http-{k.lower()}", v) for k, v in source), ("payload-digest", kept), ("payload-digest-valid", valid)]
    inform += [("block-digest", first(named, "warc-block-digest") or digest(block)), ("payload-length", str(len(payload))), *([("content-coding", "unknown")] if content is None else [])]
    text, out = text_of(content, first(source, "content-type")), []
    for kind, form, data in (("metadata", "application/warc-fields", b"".join(f"{k}: {v}".encode("utf-8", "replace") + END for k, v in inform)), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"))):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", identifier(kind, refers, digest(data))), ("WARC-Refers-To", refers), ("WARC-Date", first(named, "warc-date")), ("WARC-Target-URI", first(named, "warc-target-uri"))]
        headers += [("Content-Type", form), ("WARC-Payload-Digest", kept), ("WARC-Block-Digest", digest(data)), *((k, v) for k, v in named if k.lower() == "warc-concurrent-to")]
        headers = [(k, v) for k, v in headers if v]
        out.append((headers, data, record(headers, data)))
    return out


SCHEMA = "source_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long, record binary"


def derivatives(records: DataFrame, id_col: str | None = "source_id", record_col: str = "record", id_field: str | None = None) -> DataFrame:
    """The metadata and conversion record of each response among `records` (binary, one or more WARC records each, plain or gzip; so whole
    files will do). source_id is the column's, or else the number in the record's field id_field, null where it has none.

    Null, empty and broken records and those of other types give nothing. Repeated rows give their derivatives again. Columns other than
    the two named are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows, size = [], 0
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for named, block in parse(data or b""):
                    if id_field:
                        own = first(named, id_field.lower())
                        i = int(own) if NUMBER.fullmatch(own) else None
                    for h, body, whole in derive(named, block):
                        rows.append((i, *(first(h, k) or None for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest", "warc-block-digest")), len(body), whole))
                        size += len(whole)
                    if size > 8_000_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, names)

    own = F.col(id_col) if id_col else F.lit(None)
    return records.select(own.cast("long").alias("source_id"), F.col(record_col).alias("record")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """source_id and record: a response record for each page. Null URLs and pages are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = [response(i, u or "", p or "") for i, u, p in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["source_id", "record"])

    calm(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("p"))
    return rows.mapInArrow(run, "source_id long, record binary")


def archives(records: DataFrame, record_col: str = "record", size: int = 16 << 20) -> DataFrame:
    """name and content of files of about `size` bytes of records, each record a gzip member, as .warc.gz files are. Null and empty records
    are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, k, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in _then_none(batches):
            for data in batch.column(0).to_pylist() if batch is not None else (None,):
                if data:
                    held.append(gzip.compress(data, 1, mtime=0))
                    n += len(held[-1])
                if held and (n >= size or batch is None):
                    yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{k:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["name", "content"])
                    held, n, k = [], 0, k + 1

    return records.select(record_col).mapInArrow(run, "name string, content binary")


def records_of(files: DataFrame, name_col: str = "name", content_col: str = "content", id_field: str | None = None) -> DataFrame:
    """source_id and record of each record of the files (plain, or gzip members one after another), with all fields in their order. The id is
    the number in the field id_field where the record has it, else a hash of the file's name and the record's place. A file is read by one
    task, a record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, data, ids, made, size = batch.column(0)[row].as_py(), batch.column(1)[row], [], [], 0
                for k, (named, block) in enumerate(parse(_chunks(data))):
                    own = first(named, id_field.lower()) if id_field else ""
                    ids.append(int(own) if NUMBER.fullmatch(own) else None if id_field and not own else _place(name, k))
                    made.append(record([(n, v) for n, v in named if n.lower() != "content-length"], block))
                    size += len(made[-1])
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["source_id", "record"])
                        ids, made, size = [], [], 0
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["source_id", "record"])

    return files.select(F.col(name_col).cast("string"), content_col).mapInArrow(run, "source_id long, record binary")


def _chunks(data: pa.Scalar, size: int = 1 << 15) -> Iterator[bytes]:
    """The bytes in small pieces: what follows a gzip member in its piece is copied."""
    raw = data.as_buffer()
    for at in range(0, raw.size if raw is not None else 0, size):
        yield raw.slice(at, min(size, raw.size - at)).to_pybytes()


def _place(name: str | None, k: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{name}#{k}".encode(), digest_size=8).digest(), "little", signed=True)


def read_warc(spark, path: str) -> DataFrame:
    """source_id and record of each record of the files at path, of at most 2 GB each."""
    return records_of(spark.read.format("binaryFile").load(path), "path", "content")
