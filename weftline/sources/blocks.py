"""A data source of blocks: files of compressed Arrow blocks, each with the range of a key, and commits that name the files.

``spark.dataSource.register(Blocks)`` makes ``format("blocks")`` known, to batches and
streams, with the options ``path``, ``key`` (a column; writers only) and ``rows`` (of a
block). A task writes a file of its own and an index beside it; the driver's commit
lists the files, so what a failed or repeated task wrote is no part of the table.
Filters on the key are pushed to the index: blocks out of range are not read. A stream
takes the commits one after the other; a stream's batch that is committed again
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"  # to be true for filters to reach the index


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "/", 1))


def _read_json(uri: str, name: str):
    fs, root = _store(uri)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return json.loads(f.read())


def _write_json(uri: str, name: str, what) -> None:
    """Written aside and moved, so that it is there whole or not at all."""
    fs, root = _store(uri)
    folder = f"{root}/{name}".rpartition("/")[0]
    fs.create_dir(folder)
    aside = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(json.dumps(what).encode())
    fs.move(aside, f"{root}/{name}")


def _commits(uri: str) -> list[str]:
    """The names of the commits in their order."""
    fs, root = _store(uri)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith("."))


def _commit(uri: str, files: list[str], tag: str, schema: StructType) -> None:
    """One more commit, unless there is one with this tag."""
    names = _commits(uri)
    if any(n.endswith(f"-{tag}.json") for n in names):
        return
    if not names:
        _write_json(uri, "schema.json", schema.json())
    _write_json(uri, f"commits/{len(names):012d}-{tag}.json", files)


@dataclass
class Written(WriterCommitMessage):
    file: str


@dataclass
class File(InputPartition):
    name: str


class _Writing:
    """Writes a task's batches as blocks to a file with an index."""

    def __init__(self, options: dict, schema: StructType):
        self.uri, self.key, self.rows, self.table = options["path"], options.get("key"), int(options.get("rows", 10_000)), schema

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.uri)
        name, index = f"data/{uuid.uuid4().hex}", []
        fs.create_dir(f"{root}/data")
        with fs.open_output_stream(f"{root}/{name}") as out:
            for block in self._blocks(batches):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(block)
                data = sink.getvalue()
                index.append({"at": out.tell(), "size": len(data), "rows": block.num_rows, **self._ends(block)})
                out.write(data)
        _write_json(self.uri, f"{name}.index", index)
        return Written(name)

    def _ends(self, block: pa.Table) -> dict:
        """The least and the greatest key; none where it is of another kind or a key is NaN, which Spark puts above all numbers."""
        keys = block[self.key] if self.key else None
        if keys is None or pa.types.is_floating(keys.type) and pc.any(pc.is_nan(keys)).as_py():
            return {"min": None, "max": None}
        return {k: v if isinstance(v, (int, float, str)) else None for k, v in pc.min_max(keys).as_py().items()}

    def _blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= self.rows:
                whole = pa.Table.from_batches(held)
                yield whole.slice(0, self.rows)
                held, n = whole.slice(self.rows).to_batches(), n - self.rows
        if n:
            yield pa.Table.from_batches(held)

    def remove(self, messages: list) -> None:
        fs, root = _store(self.uri)
        for m in messages:
            if m is not None:
                for name in (m.file, f"{m.file}.index"):
                    fs.delete_file(f"{root}/{name}")


class BlocksWriter(_Writing, DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        _Writing.__init__(self, options, schema)

    def commit(self, messages: list) -> None:
        _commit(self.uri, [m.file for m in messages if m], uuid.uuid4().hex, self.table)

    def abort(self, messages: list) -> None:
        self.remove(messages)


class BlocksStreamWriter(_Writing, DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        _Writing.__init__(self, options, schema)

    def commit(self, messages: list, batchId: int) -> None:
        _commit(self.uri, [m.file for m in messages if m], f"batch{batchId}", self.table)

    def abort(self, messages: list, batchId: int) -> None:
        self.remove(messages)


class _Reading:
    """Reads the blocks of a file that the pushed filters allow."""

    filters: list[Filter] = []

    def allowed(self, block: dict, key: str | None) -> bool:
        low, high = block["min"], block["max"]
        for f in self.filters:
            if f.attribute != (key,):
                continue
            if low is None:
                continue
            v = f.value
            if isinstance(f, EqualTo) and not low <= v <= high:
                return False
            if isinstance(f, In) and not any(low <= x <= high for x in v if x is not None):
                return False
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and (high < v or isinstance(f, GreaterThan) and high == v):
                return False
            if isinstance(f, (LessThan, LessThanOrEqual)) and (low > v or isinstance(f, LessThan) and low == v):
                return False
        return True

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        fs, root = _store(self.uri)
        index = _read_json(self.uri, f"{partition.name}.index")
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            for block in index:
                if self.allowed(block, self.key):
                    yield from pa.ipc.open_stream(f.read_at(block["size"], block["at"]))


class BlocksReader(_Reading, DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.key, self.filters = options["path"], options.get("key"), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds the key; all are given back, as blocks hold rows out of the bounds too."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.filters.append(f)
            yield f

    def partitions(self) -> list[File]:
        return [File(f) for name in _commits(self.uri) for f in _read_json(self.uri, f"commits/{name}")]


class BlocksStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.key = options["path"], None

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(_commits(self.uri))}

    def partitions(self, start: dict, end: dict) -> list[File]:
        names = _commits(self.uri)[start["commits"] : end["commits"]]
        return [File(f) for name in names for f in _read_json(self.uri, f"commits/{name}")]

    def commit(self, end: dict) -> None:
        pass


class Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> StructType:
        """That of the first commit."""
        return StructType.fromJson(json.loads(_read_json(self.options["path"], "schema.json")))

    def reader(self, schema: StructType) -> BlocksReader:
        return BlocksReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BlocksWriter:
        return BlocksWriter(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> BlocksStreamReader:
        return BlocksStreamReader(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> BlocksStreamWriter:
        return BlocksStreamWriter(dict(self.options), schema)


def write_blocks(df: DataFrame, path: str, key: str, rows: int = 10_000) -> None:
    """Append ``df`` to a table of blocks, in ranges of ``key`` so that a block's range is narrow. Rows of one key are one task's."""
    df.sparkSession.dataSource.register(Blocks)
    df.repartitionByRange(key).sortWithinPartitions(key).write.format("blocks").options(path=path, key=key, rows=rows).mode("append").save()


def read_blocks(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table of blocks; filters on ``key`` are pushed to its indexes (the session's setting for it is set)."""
    spark.dataSource.register(Blocks)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("blocks").options(path=path, key=key).load()
