"""Exact search for the vectors of largest inner product, by buckets of like lengths.

Vectors are ordered by their length and cut into groups, queries into blocks. Every
block first meets the group of the longest vectors, which gives each query a score
that its results must reach. A group whose longest vector can't reach the score of any
query of a block doesn't meet that block. Within a group, buckets of vectors of like
lengths come one after the other, the longest first. What a query must reach, divided
by its own length and the bucket's greatest one, is the least cosine that a vector of
the bucket needs. Where that is above one, the bucket is skipped; where it is high,
only vectors whose coordinates lie within the ranges that the cosine leaves for the
query's largest coordinates are multiplied; else those long enough. The products of
what is left decide, so no bound loses a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._spark import checkpoint, free
from weftline.operators.ordered import numbered

GROUP = 16_384  # vectors that one task sees at once
BUCKET = 2_048
BLOCK = 512  # queries that one task sees at once
STEPS = 256.0  # a component x counts as floor(STEPS * x)
FROM_COSINE = 0.5  # from this cosine on coordinates are looked at
FOCUS = 4  # coordinates of a query that are looked at
SLACK = 1e-9  # by which bounds are wider than computed
EXACT = 2.0**53  # whole numbers below this are exact in 64-bit floating point
MERGED = 1_024  # groups whose results are merged at once


def whole(x: Column) -> Column:
    """floor(STEPS * x) as a double, at any size."""
    y = x.cast("double") * STEPS
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, size (the squared length) of the vectors without null or non-finite components. Where an id has several, the greatest stands for it; those without an id all stay."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("embedding").isNotNull() & ~bad)
    known = rows.where("vec_id is not null")
    if not known.groupBy("vec_id").count().where("count > 1").isEmpty():
        known = known.groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    return known.unionByName(rows.where("vec_id is null")).withColumn("size", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))


def _packed(vectors: DataFrame, name: str, many: int) -> tuple[DataFrame, int]:
    """Rows (``name``, high, rows) of ``many`` vectors each, the longest first, high being the greatest length; and how many there are."""
    placed = checkpoint(numbered(vectors, [], [F.col("size").desc(), F.col("vec_id").asc()]))
    packed = placed.groupBy(F.floor(F.col("place") / many).alias(name)).agg(F.sqrt(F.max("size")).alias("high"), F.collect_list(F.struct("vec_id", "embedding")).alias("rows"))  # ``many`` at most
    packed = checkpoint(packed, placed)
    return packed, packed.count()


def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether they are null, and the matrix of whole components of packed vectors; shorter vectors end with zeros."""
    items = rows.column("rows").combine_chunks().flatten()
    ids, lists = items.field("vec_id"), items.field("embedding")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS)
    matrix = np.zeros((len(lengths), max(lengths, default=0)))
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = flat
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), matrix


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with as many columns as the wider one."""
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))


class Best:
    """The ``k`` best candidates of a query so far: scores, ids and which ids are null, best first; ties to the smaller id, null last."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores = np.concatenate([self.scores, scores])
        ids, nulls = np.concatenate([self.ids, ids]), np.concatenate([self.nulls, nulls])
        if len(scores) > 4 * self.k:  # ties of the k-th best score stay for the sort
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, nulls = scores[near], ids[near], nulls[near]
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        if len(order) == self.k:
            self.least = max(self.least, float(scores[order[-1]]))


class Bucket:
    """Vectors of like lengths: ``length`` descends; ``unit`` has their directions, and lists of rows by coordinate are sorted as they are asked for."""

    def __init__(self, matrix: np.ndarray, length: np.ndarray):
        self.matrix, self.length, self.sorted = matrix, length, {}
        self.unit = matrix / np.maximum(length, 1e-300)[:, None]

    def within(self, f: int, low: float, high: float) -> tuple[np.ndarray, int, int]:
        """The rows by their coordinate ``f``, and between which places it is from low to high."""
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        order, values = self.sorted[f]
        return order, int(np.searchsorted(values, low)), int(np.searchsorted(values, high, "right"))

    def by_coordinates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that may have this cosine with the query or more, by the ranges it leaves for the coordinates in ``focus``."""
        angle, apart = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(cosine, 1.0))
        lows = np.cos(np.minimum(np.pi, angle + apart)) - SLACK
        highs = np.cos(np.maximum(0.0, angle - apart)) + SLACK
        found = [self.within(f, low, high) for f, low, high in zip(focus, lows, highs, strict=True)]
        least = min(range(len(focus)), key=lambda k: found[k][2] - found[k][1])
        order, start, stop = found[least]
        rows = order[start:stop]
        for k, f in enumerate(focus):
            if k != least:
                at = self.unit[rows, f]
                rows = rows[(at >= lows[k]) & (at <= highs[k])]
        return rows

    def candidates(self, unit: np.ndarray, focus: np.ndarray, length: float, least: float) -> np.ndarray | slice:
        """Rows that may score ``least`` or more with a query of this direction and length."""
        if least <= 0 or not length:
            return slice(None)
        need = least / length * (1 - SLACK)  # a vector's length times its cosine
        if need > self.length[0]:
            return slice(0)
        cosine = need / self.length[0]
        long_enough = slice(int(np.searchsorted(-self.length, -need, "right")))
        return self.by_coordinates(unit, focus, cosine) if cosine >= FROM_COSINE else long_enough


def search_group(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, nulls: np.ndarray, p: np.ndarray, k: int) -> list[Best]:
    """The best of a group for each query that reach its ``least``."""
    q, p = widened(q, p)
    best = [Best(k, x) for x in least]
    most = [np.abs(x).max(initial=0.0) for x in (q, p)]
    if most[0] * most[1] * max(q.shape[1], 1) >= EXACT:  # beyond exact floating point: whole numbers of Python, no bounds
        rows = [[int(x) for x in row] for row in p]
        ends = np.iinfo(np.int64)
        for b, own, row in zip(best, q_ids, ([int(x) for x in row] for row in q), strict=True):
            scores = np.array([min(max(sum(map(int.__mul__, row, r)), ends.min + 1), ends.max) for r in rows], np.int64)
            other = (ids != own) | nulls
            b.add(scores[other], ids[other], nulls[other])
        return best
    length = np.sqrt((p * p).sum(1))
    order = np.lexsort((ids, -length))
    ids, nulls, p, length = ids[order], nulls[order], p[order], length[order]
    q_length = np.sqrt((q * q).sum(1))
    unit = q / np.maximum(q_length, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    for start in range(0, len(p), BUCKET):
        at = slice(start, start + BUCKET)
        bucket, own_ids, own_nulls = Bucket(p[at], length[at]), ids[at], nulls[at]
        for n, b in enumerate(best):
            rows = bucket.candidates(unit[n], focus[n], q_length[n], b.least)
            scores = bucket.matrix[rows] @ q[n]
            good = (scores >= b.least) & ((own_ids[rows] != q_ids[n]) | own_nulls[rows])
            if good.any():
                b.add(scores[good].astype(np.int64), own_ids[rows][good], own_nulls[rows][good])
    return best


RESULT = "array<struct<query_id:bigint,vec_id:bigint,score:bigint>>"
_FOUND = pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def _met(k: int):
    """The function of a block of queries and a group: what each query found, what it must reach from now on, and the least length times cosine that any of them needs."""

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("least", pa.list_(pa.float64())), ("need", pa.float64()), ("found", _FOUND)])
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        q_ids, _, q = unpack(queries)
        ids, nulls, p = unpack(vectors)
        least = np.array(queries.column("least")[0].as_py() or [-np.inf] * len(q))
        best = search_group(q_ids, q, least, ids, nulls, p, k)
        found = [{"query_id": int(i), "vec_id": None if none else int(v), "score": int(s)} for i, b in zip(q_ids, best, strict=True) for s, v, none in zip(b.scores, b.ids, b.nulls, strict=True)]
        least = np.array([b.least for b in best])
        length = np.sqrt((q * q).sum(1))
        need = np.where((least > 0) & (length > 0), least / np.maximum(length, 1e-300), -np.inf).min()
        return pa.table([[key[0].as_py()], [key[1].as_py()], [least.tolist()], [need], pa.array([found], _FOUND)], schema=schema)

    return run


def _meet(blocks: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """block, group, least, need, found of rows of both sides with equal block and group."""
    by = ["block", "group"]
    return blocks.select(*by, "rows", "least").groupBy(*by).cogroup(groups.select(*by, "rows").groupBy(*by)).applyInArrow(_met(k), f"block long, `group` long, least array<double>, need double, found {RESULT}")


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors (vec_id, embedding) of largest inner product with each query (vec_id, embedding), all if there are fewer.

    A vector of the query's own id is no result of it. Ties go to the smaller id, null
    ids last. Vectors that are null or have components that are null or not finite take
    no part; where an id has several vectors the greatest stands for it; queries without
    an id are none. Vectors of several dimensions end with zeros. Scores beyond 64 bits
    are the largest or smallest there are. An empty table gives no rows.
    """
    groups, n_groups = _packed(usable(vectors), "group", GROUP)
    blocks, n_blocks = _packed(usable(queries).where("vec_id is not null"), "block", BLOCK)
    if not n_groups or not n_blocks:
        free(groups, blocks)
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    none = F.lit(None).cast("array<double>").alias("least")
    seeds = groups.where("`group` = 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(F.col("n").cast("long").alias("block"), "group", "rows")
    seeded = checkpoint(_meet(blocks.select("block", F.lit(0).cast("long").alias("group"), "rows", none), seeds, k))
    found = seeded.select("group", F.inline("found"))
    if n_groups > 1:
        tiles = groups.where("`group` > 0").select("group", "high", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("n")).select("group", "high", F.col("n").cast("long").alias("block"))
        tiles = checkpoint(tiles.join(seeded.select("block", "need"), "block").where(F.col("high") * (1 + SLACK) >= F.col("need")).select("block", "group"))  # a stated set of queries in blocks against groups: numbers only
        ours = blocks.join(seeded.select("block", "least"), "block").join(tiles, "block").select("block", "group", "rows", "least")
        theirs = groups.join(tiles, "group").select("block", "group", "rows")
        met = checkpoint(_meet(ours, theirs, k).select("group", F.inline("found")), tiles)
        found = found.unionByName(met)
    free(groups, blocks)
    part = _first(found.withColumn("part", F.floor(F.col("group") / MERGED)), k, "part").select("query_id", "vec_id", "score")
    return _first(part, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: five results for each row whose id divides by 50, among all rows."""
    return top_k(embeddings, embeddings.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
