"""Token counts of documents in flat token files, found by scanning for separators.

A flat file is a run of documents' token ids, each document ended by the
end-of-document id, with no index. It is read in blocks of equal size by their
byte ranges. Each block is searched at once for the separator; what it has before
its first and after its last one belongs to documents that go on in other blocks,
and a prefix scan stitches them: over the blocks of a chunk, then over the chunks
of a file, so that one long file is no single task.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._spark import checkpoint, file_system, new_folder, partitions, text_of

BLOCK_BYTES = 1 << 18
CHUNK = 1024  # blocks whose prefix scan is one task's
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def width(separator: int) -> int:
    """Bytes of an id in a flat file: two if all ids up to the separator fit, else four."""
    return 2 if separator < 1 << 16 else 4


def write_files(documents: DataFrame, path: str, folder: str) -> DataFrame:
    """Encode documents into flat files below ``folder``, one for each partition that has rows; returns file, nth, doc_id of what was written.

    Ids are little-endian unsigned integers (see ``width``); the separator is the id
    after the vocabulary's last. Nothing in a file says where documents begin: the
    returned rows name the documents in order, without places or counts. A file's
    name has the task attempt, and only finished attempts return rows, so a repeated
    or lost task leaves no half file in use. Null texts are empty.
    """
    from pyspark import TaskContext

    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc, end = encoding(path)
        ctx, out, nth, uri = TaskContext.get(), None, 0, ""
        form = f"<u{width(end)}"
        mark = np.array([end], form).tobytes()
        for b in batches:
            if b.num_rows and out is None:
                uri = f"{folder}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}.bin"
                fs, at = file_system(uri)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(at, compression=None)
            for text in b.column(1):
                out.write(np.array(enc.encode_ordinary(text.as_py()), form).tobytes() + mark)
            yield pa.RecordBatch.from_arrays([pa.array([uri] * b.num_rows, pa.string()), pa.array(np.arange(nth, nth + b.num_rows)), b.column(0)], ["file", "nth", "doc_id"])
            nth += b.num_rows
        if out is not None:
            out.close()

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, f"file string, nth long, doc_id {kind}")


def blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, start, bytes: the byte ranges of flat files (column file), dealt evenly over the tasks."""

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, at = file_system(uri)
                size = fs.get_file_info(at).size
                starts = np.arange(0, size, block_bytes)
                for k in range(0, len(starts), 100_000):
                    s = starts[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(s), pa.string()), pa.array(np.arange(k, k + len(s))), pa.array(s, pa.int64()), pa.array(np.minimum(size - s, block_bytes), pa.int64())], ["file", "block", "start", "bytes"])

    spark = files.sparkSession
    each = files.select("file").where("file is not null").distinct()
    return each.mapInArrow(run, "file string, block long, start long, bytes long").repartition(partitions(spark), "file", "block")


def scan(ranges: DataFrame, separator: int) -> DataFrame:
    """file, block, ends (separators in the block), head, tail (tokens before the first and after the last), inside (tokens between them)."""
    form = f"<u{width(separator)}"

    def run(batches):
        for b in batches:
            rows = []
            for uri, block, start, size in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                fs, at = file_system(uri)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(size, start), form)
                marks = np.flatnonzero(ids == separator)
                head = int(marks[0]) if len(marks) else len(ids)
                tail = len(ids) - int(marks[-1]) - 1 if len(marks) else 0
                rows.append((uri, block, len(marks), head, tail, np.diff(marks) - 1))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["file", "block", "ends", "head", "tail", "inside"])

    return ranges.select("file", "block", "start", "bytes").mapInArrow(run, "file string, block long, ends long, head long, tail long, inside array<long>")


def _before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds done and open, the separators before a row and the tokens since the last of them, and had, whether there is one; rows have ends and left, the tokens after their last separator (all, without one)."""
    over = Window.partitionBy(*keys).orderBy(order)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    # Tokens since the last separator: the sum of what rows leave open, less that sum before the last row with a separator.
    rows = rows.withColumn("sum", F.sum("left").over(over))
    rows = rows.withColumn("base", F.when(F.col("ends") > 0, F.col("sum") - F.col("left")))
    done = F.coalesce(F.sum("ends").over(earlier), F.lit(0))
    return rows.select(
        *[c for c in rows.columns if c not in ("sum", "base")],
        done.alias("done"),
        (F.coalesce(F.last("sum").over(earlier), F.lit(0)) - F.coalesce(F.last("base", True).over(earlier), F.lit(0))).alias("open"),
        (done > 0).alias("had"),
    )


def stitched(found: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file, block, done, open for the blocks of ``scan`` (file, block, ends, head, tail): the documents that end before a block, and the tokens already read of the one that is open there."""
    own = found.select("file", "block", F.floor(F.col("block") / chunk).alias("chunk"), "ends", F.when(F.col("ends") == 0, F.col("head")).otherwise(F.col("tail")).alias("left"))
    inner = _before(own, ["file", "chunk"], "block")
    last = F.max_by(F.struct(F.when(F.col("ends") > 0, F.col("left")).otherwise(F.col("open") + F.col("left")).alias("left")), "block")["left"]
    chunks = _before(inner.groupBy("file", "chunk").agg(F.sum("ends").alias("ends"), last.alias("left")), ["file"], "chunk")
    both = inner.join(chunks.select("file", "chunk", F.col("done").alias("chunk_done"), F.col("open").alias("chunk_open")), ["file", "chunk"])
    carried = F.when(F.col("had"), F.lit(0)).otherwise(F.col("chunk_open"))
    return both.select("file", "block", (F.col("done") + F.col("chunk_done")).alias("done"), (F.col("open") + carried).alias("open"))


def counts(files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK) -> DataFrame:
    """file, nth (place of the document in its file, from 0), n_tokens, for the flat files in column file.

    Tokens after a file's last separator belong to no whole document and are left
    out; files without tokens have no rows. Rows that repeat a file count once, null
    names not at all. Other columns are ignored; no files give no rows. ``block_bytes``
    must be a multiple of an id's bytes.
    """
    found = checkpoint(scan(blocks(files, block_bytes), separator))
    at = stitched(found.select("file", "block", "ends", "head", "tail"), chunk)
    each = found.where("ends > 0").join(at, ["file", "block"])
    sizes = F.concat(F.array(F.col("open") + F.col("head")), F.col("inside"))
    return each.select("file", "done", F.posexplode(sizes).alias("k", "n_tokens")).select("file", (F.col("done") + F.col("k")).alias("nth"), "n_tokens")


def report(documents: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row of documents, by a scan of the flat files they are written to. Repeated rows and null ids each have their row."""
    end = encoding(path)[1]
    written = checkpoint(write_files(documents, path, folder or new_folder(documents.sparkSession)))
    found = counts(written, end)
    return written.join(found, ["file", "nth"]).select("doc_id", "n_tokens")
