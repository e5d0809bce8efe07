"""WARC archives, written and read back (operator 7).

Each record is a gzip member of its own. The reader decompresses a file incrementally, member by member, frames the
block by its Content-Length, and verifies block and payload digests. It takes any archive: all record types, optional
headers left out, digests by any algorithm that Python knows in hex or base 32, chunked HTTP bodies, and several records
in a member. Of records with equal payloads of at least
``REVISIT_BYTES`` the one of the smallest page id is a response, and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, raw_bytes, table, utf8
from wayfarer.session import scratch_path, written

REVISIT_BYTES = 100
#: A file is closed once it holds this many compressed bytes.
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
#: The pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def _header_value(text: str) -> str:
    return " ".join(text.split())


def response_record(page_id: int | None, url: str | None, payload: bytes, place: str = "") -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return _record("response", record_id(page_id, place if page_id is None or len(payload) < REVISIT_BYTES else ""), url, digest, block, [])


def revisit_record(page_id: int | None, url: str | None, refers_to: int, digest: str, n_bytes: int, place: str = "") -> bytes:
    """Its block is the HTTP head alone, which still states the length of the payload left out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return _record("revisit", record_id(page_id, place), url, digest, block, [f"WARC-Profile: {profile}", f"WARC-Refers-To: {record_id(refers_to)}"])


def record_id(page_id: int | None, place: str = "") -> str:
    """The id of a page's record. Records that none refers to carry their place, so that repeated ids stay apart."""
    return f"<urn:page:{'' if page_id is None else page_id}{':' if place else ''}{place}>"


def _record(kind: str, identity: str, url: str | None, digest: str, block: bytes, more: list[str]) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {identity}",
        f"WARC-Target-URI: {_header_value(url or '') or 'about:blank'}",
        f"WARC-Date: {DATE}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *more,
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + _END + block + _END


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one by one; a cut or damaged member raises ``ValueError``."""
    held, inflate, parts, fed = b"", zlib.decompressobj(31), [], False
    while True:
        data = held or stream.read(CHUNK)
        held = b""
        if not data:
            break
        try:
            parts.append(inflate.decompress(data))
            fed = True
        except zlib.error as error:
            raise ValueError(f"damaged member: {error}") from error
        if inflate.eof:
            yield b"".join(parts)
            held, inflate, parts, fed = inflate.unused_data, zlib.decompressobj(31), [], False
    if fed:  # the first bytes of a member decompress to nothing, so its output can't tell
        raise ValueError("the last member is cut off")


@dataclass
class Record:
    """A record; ``payload`` is the HTTP body where the block is HTTP, and the block else."""

    kind: str
    record_id: str | None
    refers_to: str | None
    url: str | None
    date: str | None
    payload: bytes
    payload_bytes: int | None
    payload_digest: str | None

    @property
    def page_id(self) -> int | None:
        return _page(self.record_id)


def _head(data: bytes, strict: bool = False) -> tuple[str, dict[str, str], bytes]:
    """First line, headers and what follows the empty line; a line that begins with white space goes on from the last."""
    end, gap = data.find(_END), 4
    bare_end = -1 if strict else data.find(b"\n\n")
    if bare_end >= 0 and (end < 0 or bare_end < end):
        end, gap = bare_end, 2
    if end < 0:
        end, gap = len(data), 0
    first, *lines = data[:end].decode("utf-8", "replace").splitlines() or [""]
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields.setdefault(name, value.strip())
    return first, fields, data[end + gap :]


def _page(urn: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)[:>]", urn or "")
    return int(found[1]) if found else None


def _digest_fits(stated: str | None, *candidates: bytes) -> bool:
    """Whether one of the candidates has the stated digest; none stated, or one that can't be computed, fits all."""
    algorithm, _, value = (stated or "").partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if not value or algorithm not in hashlib.algorithms_available or algorithm.startswith("shake"):
        return True
    value = value.strip()
    for data in candidates:
        found = hashlib.new(algorithm, data)
        if value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("="):
            return True
    return False


def _unchunked(body: bytes) -> bytes | None:
    """The body of a chunked HTTP message; ``None`` where its chunks are damaged."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(parts)
        if len(body) < end + 2 + n:
            return None
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def parse_records(data: bytes) -> Iterator[Record]:
    """Frame the records of a member by their lengths and verify their digests."""
    while data:
        version, fields, rest = _head(data, strict=True)
        if not version.startswith("WARC/") or not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
            raise ValueError("not a WARC record")
        length = int(fields["content-length"])
        block = rest[:length]
        if len(block) != length or rest[length : length + 4] != _END:
            raise ValueError("the block's length is wrong")
        yield _record_of(fields, block)
        data = rest[length + 4 :]


def _record_of(fields: dict[str, str], block: bytes) -> Record:
    if not _digest_fits(fields.get("warc-block-digest"), block):
        raise ValueError("the block's digest is wrong")
    kind, stated = fields["warc-type"].lower(), fields.get("warc-payload-digest")
    payload, raw, n_bytes = block, block, len(block)
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        _, http, raw = _head(block)
        payload, n_bytes = raw, len(raw)
        if "chunked" in http.get("transfer-encoding", "").lower():
            whole = _unchunked(raw)
            payload = raw if whole is None else whole
            n_bytes = len(payload)
        elif http.get("content-length", "").isdigit():
            n_bytes = int(http["content-length"])
            if kind == "response" and n_bytes != len(raw):
                if stated is None:
                    n_bytes = len(raw)  # a cut or miscounted message is kept as it was captured
                else:
                    raise ValueError("the payload's length is wrong")
        elif kind == "revisit":
            n_bytes = None
    if kind != "revisit" and not _digest_fits(stated, payload, raw):
        raise ValueError("the payload's digest is wrong")
    algorithm, _, value = (stated or "").partition(":")
    digest = hashlib.sha256(payload).hexdigest() if kind != "revisit" else value.strip().lower() if algorithm.lower() == "sha256" else None
    return Record(kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), payload, n_bytes, digest)


def parse_record(data: bytes) -> Record:
    """The only record of a member."""
    found = list(parse_records(data))
    if len(found) != 1:
        raise ValueError("one record is wanted")
    return found[0]


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark itself would use for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        out, names, records = None, [], []

        def close() -> None:
            # A retry writes the same name; readers only see files that a finished task has listed.
            out.close()
            store.move(temp, f"{root}/{names[-1]}")

        for batch in batches:
            ids, urls, kinds, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "refers_to"))
            digests, sizes = batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist()
            for i, payload in enumerate(raw_bytes(batch.column("html"))):
                if out is None:
                    names.append(f"part-{part:05d}-{len(names):05d}.warc.gz")
                    records.append(0)
                    temp = f"{root}/.{names[-1]}.{attempt}"
                    out = store.open_output_stream(temp, compression=None)
                place = f"{part}.{len(names)}.{records[-1]}"
                if kinds[i] == "revisit":
                    record = revisit_record(ids[i], urls[i], refers[i], digests[i], sizes[i], place)
                else:
                    record = response_record(ids[i], urls[i], payload, place)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(record) + packer.flush())
                records[-1] += 1
                if out.tell() >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, n) for n in names], pa.string()), pa.array(records, pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` below ``folder`` (shared by all executors); returns ``path, records`` of the files.

    A null html is an empty payload, a null id or url is left empty; repeated rows are records of their own, and of
    those with the group's smallest id all are responses. An empty table writes no file.
    """
    bounded_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    body = utf8(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest"))
    firsts = rows.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("_digest"), "first")
    marked = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", "n_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("html")).alias("html"))
    return written(marked.mapInArrow(_write(folder, file_bytes), "path string, records long"), "warc-files")


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, date string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)
    for batch in batches:
        for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = _filesystem(path)
            rows, n = [], 0
            with store.open_input_stream(name, compression=None) as stream:
                for r in (record for member in members(stream) for record in parse_records(member)):
                    rows.append((r.page_id, r.payload_bytes, r.payload_digest, r.kind, _page(r.refers_to), r.url, r.record_id, r.date))
                    n += 1
                    if len(rows) == 4096:
                        yield packed(rows)
                        rows = []
            if expected is not None and n != expected:
                raise ValueError(f"{path}: {n} records of {expected}")
            if rows:
                yield packed(rows)


def read_archives(files: DataFrame) -> DataFrame:
    """Records of the archives that ``files`` (``path, records``) lists, one task per few files.

    A null number of records isn't checked. ``page_id`` and ``refers_to`` are null for records that this module hasn't
    written; ``payload_digest`` is the SHA-256 of the payload, and for a revisit the stated one. A damaged archive is an
    error, an empty list gives no rows, a file listed twice is read twice, and further columns of ``files`` are not read.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "records").repartition(n, "path").mapInArrow(_read, _RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
WITH rows AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM rows WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""
