"""WARC archives: captures written as request, response or revisit, and metadata records, and put together again.

Which capture of equal payloads is the response is worked out on digests alone, which are taken once. Each task then
writes its captures' records, one gzip member each, into packs of FILE_BYTES, and each pack is a file, so that a reader
needs memory for one file and one record, and a record can be read alone at its offset. Reading expands and parses each
file member by member; records meet again through their concurrent-to identifiers, and revisits meet the responses they
refer to. The digest of what was read is compared with the record's.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import joined, new_path, written

#: Payloads of fewer bytes are always responses.
MIN_BYTES = 0
#: Compressed bytes at which a file is closed; a file may be larger by one capture.
FILE_BYTES = 16 << 20
#: Uncompressed bytes from which a member's length no longer ends in a zero byte.
_LONG = 1 << 24
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = "type string, id string, uri string, date string, concurrent_to array<string>, refers_to string, digest string, payload_bytes long, payload_digest string, fields map<string,string>, file string, offset long, payload binary"


def _urn(kind: str, page: int | None, digest: str, copy: int) -> str:
    h = hashlib.md5(f"{kind}|{'~' if page is None else page}|{digest}|{copy}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; a header without a value is left out."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member of the data. Its last byte is zero: above _LONG bytes an empty member follows."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if len(data) < _LONG else out + _member(b"")


def _capture(page: int | None, url: str | None, body: bytes, digest: str, first: int | None, copy: int) -> bytes:
    """The records of one capture, a member each. first: page of the response that it revisits."""
    kind = "response" if first is None else "revisit"
    main, uri = _urn(kind, page, digest, copy), None if url is None else "".join("%20" if c.isspace() or c < " " else c for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    own: list[tuple[str, str | None]] = [("WARC-Type", kind), ("WARC-Record-ID", main), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is not None:
        own += [("WARC-Refers-To", _urn("response", first, digest, 1)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    side = lambda k, content, block: _record([("WARC-Type", k), ("WARC-Record-ID", _urn(k, page, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", content)], block)
    return b"".join(
        _member(x)
        for x in (
            side("request", "application/http;msgtype=request", f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()),
            _record([*own, ("Content-Type", "application/http;msgtype=response")], http + (body if first is None else b"")),
            side("metadata", "application/warc-fields", f"page-id: {'' if page is None else page}\r\n".encode()),
        )
    )


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _pack_batches(file_bytes: int):
    """Rows come in order of page and digest, so that repeated ones are numbered as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, last, copy = 0, None, 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["pack"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "body", "sha", "first_id")]
            for row in zip(*columns, strict=True):
                page, url, body, sha, first = (x.as_py() for x in row)
                copy, last = (copy + 1 if (page, sha) == last else 1), (page, sha)
                held.append(_capture(page, url, (body or "").encode(), base32(bytes.fromhex(sha)), first, copy))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pack()
                    held, size = [], 0
        if held:
            yield pack()

    return run


def captures(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, body, sha, first_id): first_id is the response's page for a revisit, else null.

    Equal payloads have equal SHA-1 and length. Rows without a page_id come after all others. Repeated rows of the
    smallest page are all responses. Payloads are hashed once; what is shuffled then are pages, digests and lengths,
    a payload that many pages have by parts, and then each page to the one row that says what it revisits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("body"))
    short = written(rows.select("page_id", F.sha1("body").alias("sha"), F.octet_length("body").cast("long").alias("bytes")), "digests")
    groups = short.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    groups = written(groups.where("n > 1 and first_id is not null"), "groups")
    revisits = joined(short, groups, ["sha", "bytes"], "n", short.count(), "page_id").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = written(revisits.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first_id").distinct(), "revisits")
    hashed = rows.withColumn("sha", F.sha1("body"))
    return hashed.join(revisits, hashed.page_id.eqNullSafe(revisits.p) & (hashed.sha == revisits.s), "left").select("page_id", "url", "body", "sha", "first_id")


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Archives of all pages (page_id, url, html) below path. A null html is an empty payload, a null url leaves out the target.

    Files are written by the text writer, one row each: the pack without its last byte, which is zero, and that byte as
    the line's end. Without pages nothing but an empty folder is written.
    """
    c = captures(pages, min_bytes).repartition("page_id", "sha").sortWithinPartitions("page_id", "sha", "url")
    packs = c.mapInArrow(_pack_batches(file_bytes), "pack binary")
    packs.select(F.col("pack").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def members(data: bytes, name: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of each gzip member that isn't empty; of plain data, all of it."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        parts, place = [], at
        while not z.eof:
            piece = data[place : place + 65536]
            if not piece:
                raise ValueError(f"member at byte {at} of {name} is cut short")
            parts.append(z.decompress(piece))
            place += len(piece)
        place -= len(z.unused_data)
        contents = b"".join(parts)
        if contents:
            yield at, contents
        at = place


def parse(data: bytes, name: str = "") -> Iterator[dict]:
    """The records of an archive, plain or of gzip members that hold whole records."""
    for offset, text in members(data, name):
        at = 0
        while at < len(text):
            end = text.find(b"\r\n\r\n", at)
            if end < 0 or not text.startswith(b"WARC/", at):
                raise ValueError(f"no record at byte {at} of the member at {offset} of {name}")
            headers: dict[str, list[str]] = {}
            for line in text[at:end].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                headers.setdefault(k.decode().strip().lower(), []).append(v.decode().strip())
            size = int(headers["content-length"][0])
            block = text[end + 4 : end + 4 + size]
            if len(block) < size:
                raise ValueError(f"record at byte {at} of the member at {offset} of {name} is cut short")
            at = end + 4 + size + 4
            one = lambda k: headers.get(k, [None])[0]  # noqa: E731, B023
            kind, payload, fields = one("warc-type"), None, {}
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
            if one("content-type") == "application/warc-fields":
                fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n") if x)}
            yield {
                "type": kind, "id": one("warc-record-id"), "uri": one("warc-target-uri"), "date": one("warc-date"), "concurrent_to": headers.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
                "digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": None if payload is None else len(payload),
                "payload_digest": None if payload is None else base32(hashlib.sha1(payload).digest()), "fields": fields, "file": name, "offset": offset, "payload": payload,
            }


_ARROW = pa.schema([("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())])


def _parse_batches(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for r in parse(content.as_py(), path):
                    r["fields"] = list(r["fields"].items())
                    size += len(r["payload"] or b"")
                    rows.append(r if with_payload else r | {"payload": None})
                    if len(rows) == 10_000 or with_payload and size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below path, with the file and the byte at which their member begins. payload_digest is taken from the payload that was read."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse_batches(with_payload), RECORD_SCHEMA)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row for each capture: id, type, response, request, metadata, original. recs is a table, which is read several times.

    A request or metadata record belongs to the response or revisit that it is concurrent to, directly or through one
    more record; of several the one with the smallest id is taken. original is the response that a revisit refers to;
    responses don't take part in that join, and those that many revisits refer to are met by parts.
    """
    mains = recs.where(F.col("type").isin("response", "revisit"))
    sides = recs.where(F.col("type").isin("request", "metadata")).select("type", "id", "fields", F.explode("concurrent_to").alias("target"))
    ends = mains.select(F.col("id").alias("target"), F.col("id").alias("capture"))
    direct = sides.join(ends, "target").select("type", "id", "fields", "capture")
    onward = sides.join(direct.select(F.col("id").alias("target"), "capture"), "target").select("type", "id", "fields", "capture")
    gathered = (
        direct.unionByName(onward)
        .groupBy("capture")
        .agg(*[F.min_by(F.when(F.col("type") == k, F.struct("id", "fields")), F.when(F.col("type") == k, F.col("id"))).alias(k) for k in ("request", "metadata")])
    )
    response = F.struct("uri", "date", "digest", "payload_bytes", "payload_digest", "file", "offset", "payload").alias("response")
    whole = mains.join(gathered.withColumnRenamed("capture", "id"), "id", "left").select("id", "type", "refers_to", response, "request", "metadata")
    whole = written(whole, "captures")
    named = written(whole.where("type = 'revisit' and refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n")), "named")
    original = F.struct(F.col("id").alias("id"), "response.uri", "response.payload_bytes", "response.payload_digest", "metadata").alias("original")
    found = whole.where("type = 'response'").select(F.col("id").alias("refers_to"), original).dropDuplicates(["refers_to"]).join(named, "refers_to")
    revisits = whole.where("type = 'revisit'")
    met = joined(revisits, written(found, "originals"), ["refers_to"], "n", revisits.count(), "id", "left")
    columns = ["id", "type", "response", "request", "metadata", "original"]
    return whole.where("type = 'response'").withColumn("original", F.lit(None).cast(met.schema["original"].dataType)).select(*columns).unionByName(met.select(*columns))


def report(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives (by default in the shared folder) and gives, as read from there, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are those of the payload as read: a revisit's are its original's. Where a record says another
    digest, or a revisit's original is missing, the query fails. One row for each row of pages, repeated ones too; a
    null page_id stays null. Payloads of any length are read whole. An empty table gives no rows. Other columns of
    pages than page_id, url and html are not read, whatever their names.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, min_bytes, file_bytes)
    page = lambda x: F.nullif(F.col(f"{x}.fields")["page-id"], F.lit("")).cast("long")
    read = F.coalesce("response.payload_digest", "original.payload_digest")
    wrong = F.concat(F.lit("payload and digest differ or are missing: "), F.coalesce("id", F.lit("?")))
    return assemble(written(records(spark, path, with_payload=False), "records")).select(
        page("metadata").alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.when(read == F.col("response.digest"), read).otherwise(F.raise_error(wrong)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("original.metadata").alias("refers_to"),
    )
