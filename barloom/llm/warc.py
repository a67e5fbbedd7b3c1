"""WARC derivatives: each response record gets a metadata and a plain-text conversion record, linked to it.

Both name the response in WARC-Refers-To and keep its target and date; the metadata record keeps the HTTP status and
headers, the digests that the response declared and the ones found, and the conversion's id. Ids are made from the source's
id, so a second run, or a retried task, makes the same records. A record is one row of bytes; records joined in any number
and order (each its own gzip member, if compressed) are a valid file.

HTTP bodies that came in chunks, or in gzip or deflate, are decoded first; a declared payload digest may be that of either form.

Defined cases: null content counts as empty; records that are no response, and bytes that are no record, give no derivative;
a broken, cut-off or trailing part of a file is passed over up to the next record or gzip member; a response without a body, or in
an encoding that isn't known here, gives a conversion with an empty block; rows are converted one by one, so repeated rows
stay and null ids are kept; files are unpacked piece by piece, so that a very long one is held packed, with one record of it
unpacked; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import pick, with_columns
from barloom.llm.html_text import render

CRLF = b"\r\n"
VERSION = b"WARC/1.1"
SPACE_ID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:barloom:warc")
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b"
HEAD_BYTES = 1 << 16  # held at first of a record
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_RECORD_HEAD_END = re.compile(rb"\r?\n(?:\r?\n|(WARC/))")
_LENGTH = re.compile("[0-9]{1,12}")
_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_CHUNK = re.compile(rb"([0-9a-fA-F]{1,12})[^\r\n]*+\r?\n")


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*[h for h in self.headers if h[0].lower() != "content-length"], ("Content-Length", str(len(self.block)))])
        return VERSION + CRLF + head + CRLF + self.block + CRLF + CRLF


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's customary digest


def named(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{kind} {source}')}>"


def header_lines(raw: bytes) -> list[tuple[str, str]]:
    """(name, value) pairs; a line that starts with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def unpacked(data: bytes, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a file piece by piece, gzip members unpacked; what isn't a whole member gives what could be read of it."""
    if data[:2] != MAGIC:
        yield from (data[k : k + (step << 4)] for k in range(0, len(data), step << 4))
        return
    at = 0
    while 0 <= at < len(data):
        member, pos = zlib.decompressobj(31), at
        try:
            while not member.eof and pos < len(data):
                rest = data[pos : pos + step]
                while rest and not member.eof:
                    yield member.decompress(rest, step << 4)
                    rest = member.unconsumed_tail
                pos += step
        except zlib.error:
            at = data.find(MAGIC, at + 2)
            continue
        if not member.eof:
            return
        at = data.find(MAGIC, min(pos, len(data)) - len(member.unused_data))


def records(data: bytes) -> Iterator[Record]:
    """The records in the bytes of a file, gzip members or plain. What follows a broken record is searched for the next one."""
    pieces, held, at, more = unpacked(data), b"", 0, True

    def need(n: int) -> bool:
        """Hold n bytes from `at` on, if there are so many."""
        nonlocal held, at, more
        if len(held) - at >= n or not more:
            return len(held) - at >= n
        parts, size = [held[at:]], len(held) - at
        while size < n:
            piece = next(pieces, None)
            if piece is None:
                more = False
                break
            parts.append(piece)
            size += len(piece)
        held, at = b"".join(parts), 0
        return size >= n

    while need(1):
        found = held.find(b"WARC/", at)
        if found < 0:
            at = max(at, len(held) - 4)
            if not need(len(held) - at + 1):
                return
            continue
        at = found
        size = HEAD_BYTES
        need(size)
        m = _VERSION.match(held, at)
        while m and not (end := _RECORD_HEAD_END.search(held, m.end() - 2)) and need(2 * size):  # headers may be as long as they like
            size *= 2
            m = _VERSION.match(held, at)
        if m and not end and not (end := _RECORD_HEAD_END.search(held, m.end() - 2)):
            return  # no header ends behind this one, so none of a later record does
        if not m or end[1]:  # no record, or another one's first line before the end
            at += 5
            continue
        made, length = Record(header_lines(held[m.end() : end.start()]), b""), end.end() - at
        size = made.get("Content-Length") or ""
        if not _LENGTH.fullmatch(size) or not need(length + int(size)):
            at += 5
            continue
        made.block = held[at + length : at + length + int(size)]
        yield made
        at += length + int(size)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    m = _HEAD_END.search(block)
    head, body = (block[: m.start()], block[m.end() :]) if m else (block, b"")
    first, _, rest = head.partition(b"\n")
    return first.strip().decode("latin-1"), header_lines(rest), body


def joined(body: bytes) -> bytes:
    """The body that chunks make up; the body itself where it isn't in chunks, as crawlers often store it."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        if size == 0:
            return b"".join(out)
        if m.end() + size > len(body):
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if body[at : at + 2] == CRLF else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(out) + body[at:] if out else body


def decoded(body: bytes, headers: list[tuple[str, str]]) -> bytes | None:
    """The body as it was before transfer and packing; None where its encoding isn't known here."""
    given = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in given.get("transfer-encoding", ""):
        body = joined(body)
    for name in reversed([x.strip() for x in given.get("content-encoding", "").split(",") if x.strip() not in ("", "identity")]):
        if name in ("gzip", "x-gzip") and body[:2] == MAGIC:
            body = b"".join(unpacked(body))
        elif name == "deflate":
            for bits in (15, -15):
                try:
                    body = zlib.decompressobj(bits).decompress(body)
                    break
                except zlib.error:
                    continue
        elif name not in ("gzip", "x-gzip"):
            return None
    return body


def charset_of(body: bytes, content_type: str) -> tuple[str, int]:
    """What a body is encoded in, and how long its mark is: by its byte order mark, the header, or the first meta element in 1,024 bytes; else UTF-8."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return name, len(mark)
    given = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I)
    if given:
        return given[1], 0
    meta = _META.search(body, 0, 1024) if "html" in content_type.lower() or not content_type else None
    name = meta[1].decode("ascii", "replace") if meta else "utf-8"
    return "utf-8" if name.lower().startswith("utf-16") else name, 0  # a page that names UTF-16 in ASCII is none


def text_of(body: bytes, content_type: str) -> str:
    charset, mark = charset_of(body, content_type)
    try:
        text = body[mark:].decode(charset, "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    return render(text) if "html" in content_type.lower() or not content_type else text if content_type.lower().startswith("text/") else ""


def derive(response: Record) -> tuple[Record, Record] | None:
    """The metadata and the conversion record of a response; None for other records."""
    if (response.get("WARC-Type") or "").lower() != "response":
        return None
    source = response.get("WARC-Record-ID") or named(digest(response.block), "unnamed")
    status, headers, body = http_parts(response.block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    plain = decoded(body, headers)
    text = b"" if plain is None else text_of(plain, kind).encode()
    own = {k: named(source, k) for k in ("metadata", "conversion")}
    shared = [("WARC-Refers-To", source), *[(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := response.get(k)) is not None]]
    found = digest(body)
    payload = {
        "refers-to": source, "conversion": own["conversion"], "status": status, "headers": headers, "payload-length": len(body),
        "payload-digest": found, "decoded-digest": None if plain is None else found if plain is body else digest(plain), "declared-payload-digest": response.get("WARC-Payload-Digest"), "block-digest": digest(response.block), "declared-block-digest": response.get("WARC-Block-Digest"),
    }
    meta = json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()

    def record(name: str, content_type: str, block: bytes, *more: tuple[str, str]) -> Record:
        return Record([("WARC-Type", name), ("WARC-Record-ID", own[name]), *shared, *more, ("Content-Type", content_type), ("WARC-Block-Digest", digest(block))], block)

    return record("metadata", "application/json", meta), record("conversion", "text/plain; charset=utf-8", text, ("WARC-Concurrent-To", own["metadata"]))


def response_of(url: str | None, html: str | None, date: str = DATE) -> Record:
    """A response record for a stored page, as a crawler would have written it."""
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + CRLF + CRLF + body
    target, found = (url or "").replace("\r", "").replace("\n", ""), digest(body)
    return Record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", named(f"{target} {found}", "response")), ("WARC-Date", date), ("WARC-Target-URI", target),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", found), ("WARC-Block-Digest", digest(block)),
        ],
        block,
    )


DERIVED = (
    "response_id string, metadata_id string, conversion_id string, refers_to string, target_uri string, payload_digest string, digest_ok boolean, "
    "conversion_digest string, text string, metadata binary, conversion binary"
)
BATCH_BYTES = 8 << 20


def derived_row(source: Record) -> dict | None:
    made = derive(source)
    if made is None:
        return None
    meta, conversion = made
    facts = json.loads(meta.block)
    declared = facts["declared-payload-digest"]
    return {
        "response_id": facts["refers-to"], "metadata_id": meta.get("WARC-Record-ID"), "conversion_id": conversion.get("WARC-Record-ID"), "refers_to": conversion.get("WARC-Refers-To"),
        "target_uri": conversion.get("WARC-Target-URI"), "payload_digest": facts["payload-digest"], "digest_ok": declared is None or declared in (facts["payload-digest"], facts["decoded-digest"]),
        "conversion_digest": conversion.get("WARC-Block-Digest"), "text": conversion.block.decode(), "metadata": meta.to_bytes(), "conversion": conversion.to_bytes(),
    }


def derivatives(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """One row for each response in the binary column content: the columns keep of its file, and those of DERIVED."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    src, new = pick(files, *dict.fromkeys([*keep, content])), StructType.fromDDL(DERIVED)
    out = StructType([*[src.schema[k] for k in keep], *new.fields])
    arrow = to_arrow_schema(new)

    def made_of(it):
        for whole in it:
            rows, of, size = [], [], 0

            def batch():
                own = [whole.column(k).take(pa.array(of, pa.int64())) for k in keep]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, *[pa.array([r[f.name] for r in rows], f.type) for f in arrow]], names=[*keep, *arrow.names])  # noqa: B023

            for k, data in enumerate(whole.column(content)):
                for record in records(data.as_py() or b""):
                    if (row := derived_row(record)) is not None:
                        rows.append(row)
                        of.append(k)
                        size += len(row["conversion"]) + len(row["metadata"])
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, of, size = [], [], 0
            if rows:
                yield batch()

    return src.mapInArrow(made_of, out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of WARC files; one file, of 2 GB at most, is read by one task, which holds it as it is stored."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def page_records(pages: DataFrame) -> DataFrame:
    """page_id and content: one response record for each page, as bytes."""
    from pyspark.sql import functions as F

    both = pages.select("page_id", F.struct("url", "html").alias("page"))
    return with_columns(both, ["page_id"], "page", "content binary", lambda rows: [[response_of(r["url"], r["html"]).to_bytes() for r in rows]])


def page_derivatives(pages: DataFrame) -> DataFrame:
    """page_id, the ids and digests of its records, and the conversion's text: one row for each page."""
    from pyspark.sql import functions as F

    found = derivatives(page_records(pages), ["page_id"])
    return found.select("page_id", "response_id", "metadata_id", "conversion_id", "refers_to", "target_uri", "payload_digest", "digest_ok", "conversion_digest", F.length("text").cast("long").alias("text_chars"), "text")
