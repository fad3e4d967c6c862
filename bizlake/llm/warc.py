"""Pages written as WARC archives and read back.

Writing: of equal payloads the record with the largest page id is a response, the
others revisit it.  Equality is told by SHA-256 before anything moves; if few
payloads repeat, their list is small and joins without a shuffle.  Every record
is one gzip member.  A task writes its own archives, under names no other
attempt uses, and hands on their paths; files of attempts that did not end well
are listed nowhere and never read.

Reading: one pass per archive from its first byte to its last.  Compressed bytes
come in pieces, each member is inflated as far as its record is asked for, the
record's header gives the length of its block, and digests of block and payload
are taken as the bytes pass.  A revisit holds no payload; its size comes from the
response that its header names.

Archives are opened in the tasks through pyarrow, by the scheme of the folder
(local or mounted paths, hdfs, s3, gs); the folder must be one all executors see.

Defined cases: a null payload counts as empty; payloads under ``min_bytes`` are all
responses; of rows that repeat page id and payload one is the response and the
others revisit it; a null page id is response only if no copy has an id, and
``refers_to`` is then null; null urls become ``urn:page``; blanks and controls in
urls are escaped; an empty table gives no archive.  A record whose digest or
framing is wrong is reported in ``problem``, as is an archive that ends early; what
follows an unreadable member of an archive is not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, settle
from .common import as_batch

#: Compressed bytes after which a task starts another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes read from an archive at once, and inflated at once.
PIECE_BYTES = 1 << 18
#: Longest header of a record or of its HTTP message.
HEADER_BYTES = 1 << 20
#: Payloads from this size on are told as revisits.
MIN_BYTES = 0
#: Date of all records; a parameter, never the clock.
DATE = "2024-01-01T00:00:00Z"

NAMES = uuid.UUID("6f5b1c1e-7a52-4a0e-9a86-0f2d3c0f8b11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
READ = pa.schema([
    ("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("refers_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("problem", pa.string()),
])
READ_SCHEMA = """page_id long, record_id string, record_type string, target_uri string, refers_record string,
                 payload_bytes long, payload_digest string, payload binary, problem string"""


def filesystem(path: str):
    """pyarrow file system and the path within it."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _named(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, text)}>"


def response_id(page_id: int | None, sha1_hex: str, sha256_hex: str) -> str:
    """Record id of the one response of its payload, as known to its revisits."""
    return _named(f"response {page_id} {sha1_hex} {sha256_hex}")


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(row: dict, place: str, date: str) -> bytes:
    revisit, size = row["is_revisit"], row["n_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if revisit else row["payload"])
    url = row["url"]
    alone = revisit or not row["is_shared"]
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _named(place) if alone else response_id(row["page_id"], row["sha1"], row["sha256"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", f"urn:page:{row['page_id']}" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)),
        ("WARC-Payload-Digest", "sha1:" + base32_sha1(bytes.fromhex(row["sha1"]))),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if row["page_id"] is not None:
        headers.append(("X-Page-ID", str(row["page_id"])))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", response_id(row["keep"], row["sha1"], row["sha256"]))]
    return member(headers, block)


def _write(batches, folder: str, archive_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    files, base = filesystem(folder)
    files.create_dir(base, recursive=True)
    out, name, n, size = None, "", 0, 0

    def listed():
        out.close()
        return as_batch({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]}, WRITTEN)

    for row in (r for batch in batches for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
        if out is None:
            name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            out = files.open_output_stream(f"{base}/{name}", compression=None)
        data = _record(row, f"{name} {n}", date)
        out.write(data)
        n, size = n + 1, size + len(data)
        if size >= archive_bytes:
            yield listed()
            out = None
    if out is not None:
        yield listed()


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, n_bytes, sha1, sha256, is_revisit, is_shared, keep) per row; revisits without payload."""
    payload = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha256", F.sha2("payload", 256))
    per_id = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("sha256", "page_id").agg(F.count("*").alias("n"))
    groups = per_id.groupBy("sha256").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("size")).filter("size > 1")
    groups = settle(groups.select("sha256", F.col("top.page_id").alias("keep"), F.col("top.n").alias("n_keep"), F.lit(True).alias("is_shared")), "shared")
    joined = rows.join(groups, "sha256", "left").withColumn("is_shared", F.coalesce("is_shared", F.lit(False)))
    at_top = F.col("page_id").eqNullSafe(F.col("keep"))

    def finish(part: DataFrame, is_revisit: Column) -> DataFrame:
        part = part.withColumn("is_revisit", is_revisit).withColumn("sha1", F.sha1("payload"))
        body = F.when(~F.col("is_revisit"), F.col("payload"))
        return part.select("page_id", "url", body.alias("payload"), "n_bytes", "sha1", "sha256", "is_revisit", "is_shared", "keep")

    if groups.filter("n_keep > 1").isEmpty():
        return finish(joined, F.col("is_shared") & ~at_top)
    # rows that repeat the winning id: kept as a table so that their numbers stand still, the least one is the response
    tie = F.coalesce((F.col("n_keep") > 1) & at_top, F.lit(False))
    tied = settle(joined.filter(tie).withColumn("row", F.monotonically_increasing_id()), "tied")
    first = tied.groupBy("sha256").agg(F.min("row").alias("first"))
    rest = finish(joined.filter(~tie), F.col("is_shared") & ~at_top)
    return rest.unionByName(finish(tied.join(first, "sha256"), F.col("row") != F.col("first")))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """(path, records, bytes) of the archives written for :func:`mark_revisits` rows."""
    return settle(marked.mapInArrow(lambda batches: _write(batches, folder, archive_bytes, date), "path string, records long, bytes long"), "archives")


class _Archive:
    """Bytes of one archive in pieces; what a member did not use goes back."""

    def __init__(self, stream):
        self.stream, self.left = stream, b""

    def take(self) -> bytes:
        data, self.left = self.left or self.stream.read(PIECE_BYTES), b""
        return data


class _Member:
    """One gzip member, inflated piece by piece as it is read."""

    def __init__(self, archive: _Archive):
        self.archive, self.inflate, self.have = archive, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate another piece; false at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.archive.take()
        if not data:
            raise ValueError("archive ends inside a record")
        self.have += self.inflate.decompress(data, PIECE_BYTES)
        if self.inflate.eof:
            self.archive.left = self.inflate.unused_data
        return True

    def head(self) -> bytes:
        """Everything up to the next empty line, which is dropped."""
        while (at := self.have.find(b"\r\n\r\n")) < 0:
            if len(self.have) > HEADER_BYTES or not self.more():
                raise ValueError("header without an end")
        found, self.have = self.have[:at], self.have[at + 4 :]
        return found

    def body(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.have and not self.more():
                raise ValueError("block shorter than its length says")
            piece, self.have = self.have[:n], self.have[n:]
            n -= len(piece)
            if piece:
                yield piece

    def close(self) -> None:
        """The record's end: two line breaks and nothing else."""
        while self.more():
            if len(self.have) > 4:
                break
        if self.have != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")


def _fields(head: bytes, first: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(first):
        raise ValueError(f"no {first.decode()} header")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _read_record(one: _Member, with_payload: bool) -> dict:
    fields = _fields(one.head(), b"WARC/")
    block, payload, parts = hashlib.sha1(), hashlib.sha1(), []
    size, pending = 0, b"" if fields.get("content-type", "").startswith("application/http") else None
    for piece in one.body(int(fields["content-length"])):
        block.update(piece)
        if pending is not None:  # still inside the HTTP header
            pending += piece
            at = pending.find(b"\r\n\r\n")
            if at < 0:
                if len(pending) > HEADER_BYTES:
                    raise ValueError("header without an end")
                continue
            piece, pending = pending[at + 4 :], None
        payload.update(piece)
        size += len(piece)
        if with_payload:
            parts.append(piece)
    one.close()
    kind = fields.get("warc-type")
    stated = {k: fields.get(k, "").removeprefix("sha1:") for k in ("warc-block-digest", "warc-payload-digest")}
    problem = None
    if stated["warc-block-digest"] and stated["warc-block-digest"] != base32_sha1(block.digest()):
        problem = "block digest differs"
    elif kind != "revisit" and stated["warc-payload-digest"] and stated["warc-payload-digest"] != base32_sha1(payload.digest()):
        problem = "payload digest differs"
    revisit = kind == "revisit"
    return {
        "page_id": int(fields["x-page-id"]) if "x-page-id" in fields else None, "record_id": fields.get("warc-record-id"),
        "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_record": fields.get("warc-refers-to"),
        "payload_bytes": None if revisit else size, "payload_digest": stated["warc-payload-digest"] if revisit else base32_sha1(payload.digest()),
        "payload": b"".join(parts) if with_payload and not revisit else None, "problem": problem,
    }


def records_of(stream, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in order; the last may only tell a problem."""
    archive = _Archive(stream)
    while archive.left or (data := archive.take()):
        if not archive.left:
            archive.left = data
        try:
            yield _read_record(_Member(archive), with_payload)
        except (ValueError, KeyError, zlib.error) as e:
            yield dict.fromkeys(READ.names) | {"problem": f"unreadable: {e}"}
            return


def _read(batches, with_payload: bool) -> Iterator[pa.RecordBatch]:
    for path in (p for batch in batches for p in batch.column("path").to_pylist()):
        files, at = filesystem(path)
        rows, held = [], 0
        with files.open_input_stream(at, compression=None) as stream:
            for record in records_of(stream, with_payload):
                rows.append(record)
                held += 200 + len(record["payload"] or b"")
                if held > PIECE_BYTES:
                    yield as_batch({c: [r[c] for r in rows] for c in READ.names}, READ)
                    rows, held = [], 0
        if rows:
            yield as_batch({c: [r[c] for r in rows] for c in READ.names}, READ)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives at ``path``; payloads only where asked for."""
    paths = archives.select("path")
    return paths.repartition(max(paths.count(), 1)).mapInArrow(lambda batches: _read(batches, with_payload), READ_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the page id and size of the response each revisit names, and its digest checked."""
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"),
    )
    found = records.filter("record_type = 'revisit'").join(responses, "refers_record", "left")
    wrong = F.when(F.col("full_digest").isNull(), F.lit("no such response")).when(F.col("full_digest") != F.col("payload_digest"), F.lit("payload digest differs"))
    revisits = found.withColumn("payload_bytes", F.col("full_bytes")).withColumn("problem", F.coalesce("problem", wrong)).drop("full_bytes", "full_digest")
    others = records.filter("record_type is null or record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return others.unionByName(revisits)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written and read back; a record that does not verify stops the job."""
    marked = mark_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    archives = write_archives(marked, fresh_path(spark, "warc"))
    records = settle(read_archives(archives).drop("payload"), "records")
    checked = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("problem")))
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")


def _base32_sql(sha1_hex: str) -> str:
    """Base32 of 40 hex digits: five digits give four letters."""
    value = "('0x' || substr({h}, {at}, 5))::BIGINT"
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({v} >> {s}) & 31)::INT + 1, 1)"
    return " || ".join(letter.format(v=value.format(h=sha1_hex, at=5 * g + 1), s=s) for g in range(8) for s in (15, 10, 5, 0))


OP12_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (
  SELECT page_id, strlen(h) AS n, sha1(h) AS hex,
         row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY h) AS top
  FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, {_base32_sql('hex')} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN top END AS refers_to
FROM r
"""
