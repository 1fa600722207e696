"""WARC archives: writing, and the normaliser of archives that are one gzip stream.

``write_archives`` writes each archive as a single gzip stream, which can only be
read from its start. ``normalise`` inflates such a stream once, writes every
record as a gzip member of its own and an index of the members beside it;
``read_records`` then reads any record alone, by its offset.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import checkpoint, file_system, new_folder, partitions

MIN_BYTES = 100  # smaller payloads are never revisits
ARCHIVE_BYTES = 32 << 20  # of payload; then the next archive begins
CHUNK = 1 << 20
LEVEL = 4
URN = "urn:weftline:page"  # of a null id; any other follows it after a colon, percent-encoded


def _open(uri: str, mode: str):
    """A file in any store that pyarrow knows by its URI; the folder is the shared one."""
    fs, path = file_system(uri)
    if mode == "wb":
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(path, compression=None)
    return fs.open_input_file(path) if mode == "at" else fs.open_input_stream(path, compression=None)


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null for responses).

    Digests are grouped with partial sums first; only those of repeated payloads are joined back.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    narrow = own.where((F.octet_length("payload") >= MIN_BYTES) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = checkpoint(first)  # written: Spark splits a frequent digest only where both sides of a join are shuffled for it
    later = narrow.join(first, "payload_digest").where("page_id > first").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("first").alias("refers_to"))
    later = checkpoint(later.distinct())
    return own.join(later, (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_id", "_digest")


def named(page_id) -> str:
    return URN if page_id is None else f"{URN}:{quote(str(page_id), safe='')}"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{named(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{named(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of one gzip stream each below ``folder``; returns archive, records of what was written.

    A file's name has the task attempt, and only files of finished attempts are
    listed, so a repeated or lost task leaves no half file in use.
    """

    def run(batches):
        ctx, number, out, gz, size, n = TaskContext.get(), 0, None, None, 0, 0
        name = ""

        def end():
            out.write(gz.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])

        for b in batches:
            for row in zip(*b.columns, strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name = f"{folder}/whole/{ctx.partitionId():06d}-{number:04d}-{ctx.taskAttemptId()}.warc.gz"
                    out, gz, size, n, number = _open(name, "wb"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0, number + 1
                out.write(gz.compress(record(page_id, url, payload, digest, refers_to)))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    yield end()
                    out = None
        if out is not None:
            yield end()

    rows = deduplicated(pages).select("page_id", "url", "payload", "payload_digest", "refers_to")
    return rows.mapInArrow(run, "archive string, records long")


def _stream(uri: str) -> Iterator[bytes]:
    """The whole records of an archive, whether it is one gzip stream or many members."""
    gz, held, chunk, full = zlib.decompressobj(31), bytearray(), b"", False
    need = -1
    with _open(uri, "rb") as f:
        while chunk or full or (chunk := f.read(CHUNK)):
            out = gz.decompress(chunk, CHUNK)  # at most: a small file can inflate to a very large one
            held += out
            full = len(out) == CHUNK and not gz.eof  # more may be waiting inside
            chunk = gz.unused_data if gz.eof else gz.unconsumed_tail
            if gz.eof:
                gz = zlib.decompressobj(31)
            while True:
                if need < 0 and (at := held.find(b"\r\n\r\n")) >= 0:
                    need = at + 4 + int(fields(bytes(held[:at]))["content-length"]) + 4
                if need < 0 or len(held) < need:
                    break
                yield bytes(held[:need])
                del held[:need]
                need = -1
    if held:
        raise ValueError(f"{uri} ends within a record")


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive (column archive) with a gzip member for each record.

    Writes NAME.warc.gz and its sidecar NAME.index (a JSON line for each record)
    below ``folder``; returns the index: archive, offset, length, record_id, record_type.
    """

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for uri in b.column(0).to_pylist():
                name = f"{folder}/members/{uri.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}"
                index, offset = [], 0
                with _open(f"{name}.warc.gz", "wb") as out, _open(f"{name}.index", "wb") as side:
                    for rec in _stream(uri):
                        gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gz.compress(rec) + gz.flush()
                        out.write(member)
                        head = fields(rec[: rec.index(b"\r\n\r\n")])
                        row = {"archive": f"{name}.warc.gz", "offset": offset, "length": len(member), "record_id": head["warc-record-id"], "record_type": head["warc-type"]}
                        side.write(json.dumps(row).encode() + b"\n")
                        index.append(row)
                        offset += len(member)
                        if len(index) >= 10_000:
                            yield pa.RecordBatch.from_pylist(index, SCHEMA)
                            index = []
                if index:
                    yield pa.RecordBatch.from_pylist(index, SCHEMA)

    SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
    spread = archives.select("archive").repartition(partitions(archives.sparkSession))  # whole files, dealt evenly
    return spread.mapInArrow(run, "archive string, offset long, length long, record_id string, record_type string")


def read_records(index: DataFrame, id_type: str = "long") -> DataFrame:
    """Read each record of an index by its offset: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits). Ids are of ``id_type``."""

    def run(batches):
        held, f = None, None
        for b in batches:
            rows = []
            for uri, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if uri != held:
                    held, f = uri, _open(uri, "at")
                rec = zlib.decompress(f.read_at(length, offset), 31)
                top = rec.index(b"\r\n\r\n")
                head, block = fields(rec[:top]), rec[top + 4 : -4]
                at = block.index(b"\r\n\r\n")
                size, payload = int(fields(block[:at])["content-length"]), block[at + 4 :]
                digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"a record of {uri} at {offset} has another payload than its header says")
                own = lambda x: unquote(x.strip("<>").removeprefix(URN)[1:]) if x and x.strip("<>") != URN else None
                rows.append((own(head["warc-record-id"]), size, digest, kind, own(head.get("warc-refers-to")), payload if kind == "response" else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    read = index.select("archive", "offset", "length").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html; others are ignored) as archives, normalise them and read them back.

    Null html is empty. Of equal payloads of at least 100 bytes the smallest page_id
    is the response, later ids revisit it; rows with a null page_id, and rows that
    repeat that first id, are responses. An empty table gives no archives and no rows.
    """
    folder = folder or new_folder(pages.sparkSession)
    whole = checkpoint(write_archives(pages, folder))
    index = checkpoint(normalise(whole, folder))
    return read_records(index, pages.schema["page_id"].dataType.simpleString())


def report(pages: DataFrame) -> DataFrame:
    return round_trip(pages).drop("payload")
