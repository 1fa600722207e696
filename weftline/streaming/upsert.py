"""A stream of changes merged into a table of Parquet files, by key and version.

Keys are dealt to a fixed number of buckets by hash. A bucket is one run of rows or several,
each in the folder of the batch that wrote it. A batch rewrites the buckets that its keys are in
while they are small (SMALL rows); to a larger one it adds a run, and merges the last runs into it
once RUNS of them are not much larger, so that a row is rewritten a few times at most however many
batches come. Readers merge a bucket's runs. A batch is committed by one small file that names the
runs of every bucket; readers see the last commit's. A batch that comes again changes nothing: if it was
committed it is left out, else its folder is written anew. Deleted keys stay as rows
with their version, so that an older change that comes late does not bring them back.
"""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

BUCKETS = 16
SMALL = 100_000  # rows of a bucket that is rewritten whole
RUNS = 8
PIECES = 8  # of a bucket, by key: the tasks that can merge it
DELETED, BUCKET = "_deleted", "_bucket"


class Table:
    """A table of rows (``schema``) with one row for each ``key`` at its greatest ``version``, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, version: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.version, self.buckets = spark, path.rstrip("/"), key, version, buckets
        self.schema = schema
        self.stored = StructType([*schema.fields, StructField(DELETED, BooleanType()), StructField(BUCKET, IntegerType())])
        self.fs, self.root = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else self.path.replace("file:/", "/", 1))

    def _commits(self) -> dict[int, str]:
        """The batches that are committed, with their commit files."""
        files = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return {int(f.base_name.removesuffix(".json")): f.path for f in files if f.base_name.endswith(".json")}

    def _folders(self) -> dict[str, str]:
        """The folder of each bucket's first run, by the last commit."""
        return {b: runs[0][0] for b, runs in self._runs().items()}

    def _runs(self) -> dict[str, list]:
        """The runs (folder, rows) of each bucket, by the last commit, oldest first."""
        commits = self._commits()
        return self._named(commits[max(commits)]) if commits else {}

    def _named(self, commit: str) -> dict[str, list]:
        with self.fs.open_input_stream(commit) as f:
            named = json.loads(f.read())
        return {b: [[runs, 0]] if isinstance(runs, str) else runs for b, runs in named.items()}

    def _rows(self, folders: list[tuple[str, str]]) -> DataFrame:
        """The rows of runs (bucket, folder)."""
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        paths = [f"{self.path}/data/{x}/{BUCKET}={b}" for b, x in folders]
        return self.spark.read.schema(self.stored).option("basePath", f"{self.path}/data").parquet(*paths).select(self.stored.names)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The row of each key that stays. Rows are dealt out once, by bucket and piece, and compared there."""
        piece = F.pmod(F.xxhash64(self.key, F.lit("piece")), F.lit(PIECES)).cast("int")
        dealt = rows.withColumn("_piece", piece).repartition(BUCKET, "_piece")
        row = F.struct(*rows.columns)
        return dealt.groupBy(BUCKET, "_piece", self.key).agg(F.max_by(row, F.struct(self.version, DELETED, F.to_json(row))).alias("r")).select("r.*")

    def read(self) -> DataFrame:
        """The table's rows as of the last commit, deleted ones left out."""
        runs = self._runs()
        single, several = ([(b, x) for b, each in runs.items() if (len(each) > 1) == many for x, _ in each] for many in (False, True))
        rows = self._rows(single)
        if several:
            rows = rows.unionByName(self._last(self._rows(several)))
        return rows.where(f"not {DELETED}").select(self.schema.names)

    def merge(self, changes: DataFrame, batch: int, deleted: str) -> None:
        """Merge changes (rows with ``deleted``, a boolean column) as batch number ``batch``; batches come in rising order.

        Of a key the greatest version stays; of rows with one version the one deleted, or else the
        greatest. Changes without a key or version are left out. A batch that is committed is left out whole.
        """
        if batch in self._commits():
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = changes.where(F.col(self.key).isNotNull() & F.col(self.version).isNotNull())
        new = new.select(*self.schema.names, F.coalesce(F.col(deleted), F.lit(False)).alias(DELETED), bucket.alias(BUCKET))
        touched = {str(r[BUCKET]): r["count"] for r in new.groupBy(BUCKET).count().collect()}  # ``buckets`` at most
        runs, name = self._runs(), f"batch={batch}"
        merged = {b: self._merged(runs.get(b, []), n) for b, n in touched.items()}
        if touched:
            old = [(b, x) for b, each in merged.items() for x, _ in each]
            self._last(self._rows(old).unionByName(new)).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        for b, n in touched.items():
            kept = runs.get(b, [])[: len(runs.get(b, [])) - len(merged[b])]
            runs[b] = [*kept, [name, n + sum(m for _, m in merged[b])]]
        self.fs.create_dir(f"{self.root}/commits")
        with self.fs.open_output_stream(f"{self.root}/commits/.{batch}") as f:
            f.write(json.dumps(runs).encode())
        self.fs.move(f"{self.root}/commits/.{batch}", f"{self.root}/commits/{batch}.json")

    @staticmethod
    def _merged(runs: list, n: int) -> list:
        """Those of a bucket's runs, its last ones, that a run of ``n`` rows is merged with."""
        if n + sum(m for _, m in runs) <= SMALL:
            return runs
        stay = len(runs)
        while True:
            alike = stay
            while alike and runs[alike - 1][1] < RUNS * n:
                alike -= 1
            if stay - alike + 1 < RUNS:
                return runs[stay:]
            n += sum(m for _, m in runs[alike:stay])  # the merged run may be the last that its like wait for
            stay = alike

    def clean(self, keep: int = 1) -> int:
        """Remove the runs that none of the last ``keep`` commits names; how many these were.

        Readers of an older commit lose theirs. Files of a batch after the last commit stay, and so do
        the commits, which tell what a batch that comes again is.
        """
        if keep < 1:
            raise ValueError("the last commit is kept")
        commits = self._commits()
        used = {(name, f"{BUCKET}={b}") for k in sorted(commits)[-keep:] for b, runs in self._named(commits[k]).items() for name, _ in runs}
        old = [f for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/data", allow_not_found=True)) if int(f.base_name.removeprefix("batch=")) <= max(commits, default=-1)]
        unused = [b.path for f in old for b in self.fs.get_file_info(pafs.FileSelector(f.path)) if b.base_name.startswith(BUCKET) and (f.base_name, b.base_name) not in used]
        for path in unused:
            self.fs.delete_dir(path)
        return len(unused)

    def follow(self, changes: DataFrame, checkpoint: str, deleted: str) -> None:
        """Merge all that a stream of changes has now, batch by batch."""
        query = changes.writeStream.foreachBatch(lambda df, k: self.merge(df, k, deleted)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
