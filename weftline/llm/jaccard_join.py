"""Near-duplicate documents by a grouped prefix join on the Jaccard likeness of word shingles.

Documents with one set of shingles are one class. A set is put in one order for
all (rarer shingles first); two like sets share a shingle of their prefixes.
Classes of the same size and the same prefix are one group, and only groups are
paired: by a shared prefix shingle, their sizes, and its places. The pairs of
groups are then expanded to classes and verified on the whole sets, after pairs
that count sketches of the sets prove too unlike are left out.

Pairs are made in two rounds. In the first, each group meets one group for each of
its prefix shingles: the one that shares most of its own prefix with others, which
is the text that others were copied from rather than a copy with words of its own.
What is linked then needs no more pairs among itself, so the second round only
pairs groups that are in no common component. There a parity bitmap of each set is
compared within the join: bits that differ are shingles that differ, so a pair
with too many of them is never made, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._rolling import SECOND, mixed, spans, windows, word_hashes
from weftline.llm._rows import id_type, one_row_per_id, signed
from weftline.llm._spark import checkpoint
from weftline.llm.components import components

BUCKETS = 1 << 18  # counters of shingles: 2 MB at any size of the corpus
BIT_WORDS = 8  # 64-bit words of a set's parity bitmap


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending; fewer words than a shingle has are one shingle."""
    h = word_hashes(np.frombuffer(text, np.uint8), lowered=True)
    if not len(h):
        return h
    return np.unique(windows(h, words) if len(h) >= words else spans(h, np.array([0]), np.array([len(h)])))


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each of at least as many buckets, a power of two; a byte each, 255 stands for that or more."""
    size = 1 << max(0, len(s) - 1).bit_length()
    return np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of BIT_WORDS words: bit k is set if an odd number of shingles fall into bucket k."""
    at = (mixed(s, SECOND) & np.uint64(64 * BIT_WORDS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * BIT_WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def most_shared(x: bytes, y: bytes) -> int:
    """No fewer than the shingles that two sketched sets share; the larger sketch is folded to the smaller's buckets."""
    a, b = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y))
    a[a == 255] = b[b == 255] = 1 << 32
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, size).sum(axis=0), b.reshape(-1, size).sum(axis=0)).sum())


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all documents fall into each counter; summed by Spark, BUCKETS numbers in all."""

    def run(batches):
        total, held, n = np.zeros(BUCKETS, np.int64), [], 0
        for b in batches:
            for text in b.column(0):
                held.append((shingles(text.as_py().encode(), words) >> np.uint64(46)).astype(np.int64))
                n += len(held[-1])
                if n > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in found.toLocalIterator():
        out[r.bucket] = r.n
    return out


def _signatures(docs: DataFrame, kind: str, words: int, percent: int, counts) -> DataFrame:
    """doc_id, n, two hashes of the set, its prefix in the common order, that prefix's hash, the set's sketch and its parity bitmap."""

    def run(batches):
        often = np.minimum(counts.value, (1 << 28) - 1).astype(np.uint64)
        for b in batches:
            cols = [[] for _ in range(7)]
            for text in b.column(1):
                s = shingles(text.as_py().encode(), words)
                n = len(s)
                keep = n - (percent * n + 99) // 100 + 1 if n else 0
                rank = often[(s >> np.uint64(46)).astype(np.int64)] << np.uint64(36) | s >> np.uint64(28)  # shingles are ascending: equal ranks keep that order
                order = np.argsort(rank, kind="stable")[:keep]
                zero, end = np.array([0]), np.array([n])
                cols[0].append(n)
                cols[1].append(int(signed(spans(s, zero, end))[0]) if n else 0)
                cols[2].append(int(signed(spans(mixed(s, SECOND), zero, end, 1))[0]) if n else 0)
                cols[3].append(signed(s[order]))
                cols[4].append(int(signed(spans(s[order], zero, np.array([keep])))[0]) if n else 0)
                cols[5].append(sketch(s))
                cols[6].append(parity(s))
            arrays = [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "n", "s1", "s2", "prefix", "prefix_hash", "sketch", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, s1 long, s2 long, prefix array<long>, prefix_hash long, sketch binary, bits array<long>")


def _enough(percent: int, na: Column, nb: Column, shared: Column) -> Column:
    return (100 + percent) * shared.cast("long") >= percent * (na + nb).cast("long")


def _alike(percent: int, x: str, y: str) -> Column:
    """Whether the bitmaps bits{x}, bits{y} of sets of n{x}, n{y} shingles allow a link; true where one is null.

    Each bit that differs stands for a shingle that only one of the sets has; linked
    sets differ in (100 - percent) / (100 + percent) of their summed sizes at most.
    """
    differ = F.lit(0)
    for k in range(BIT_WORDS):
        differ += F.bit_count(F.get(F.col(f"bits{x}"), F.lit(k)).bitwiseXOR(F.get(F.col(f"bits{y}"), F.lit(k))))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(f"n{x}") + F.col(f"n{y}")), F.lit(True))


def _possible(pairs: DataFrame, signs: DataFrame, kind: str, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of documents that their sketches don't prove too unlike."""

    def bound(batches):
        for b in batches:
            good = []
            for na, nb, x, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                shared = min(na, nb, most_shared(x, y))
                good.append(100 * shared >= percent * (na + nb - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    known = signs.where("n > 0 and doc_id is not null")
    one, two = (known.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("a", "b"))
    return checkpoint(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(bound, f"a {kind}, b {kind}"))


def _verified(pairs: DataFrame, docs: DataFrame, signs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of documents that are like enough, by their whole sets."""
    kind = id_type(docs)
    pairs = _possible(pairs, signs, kind, percent)
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py().encode(), words).tobytes() for x in b.column(1)], pa.binary())], ["id", "shingles"])

    known = checkpoint(docs.join(ends, F.col("doc_id") == F.col("id")).select("doc_id", "text").mapInArrow(sets, f"id {kind}, shingles binary"))

    def compare(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = known.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), known.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return checkpoint(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(compare, f"a {kind}, b {kind}"), known)


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same shingles), component_id (smallest id reachable by links).

    Documents link when 100 * shared >= percent * union of their distinct shingles.
    One row per id: where an id has several rows the greatest text stands for it. A
    null id stays null and links with nothing, as does a text without words. Of
    documents only doc_id and text are used; an empty table gives no rows.
    """
    docs, kind = one_row_per_id(documents), id_type(documents)
    counts = documents.sparkSession.sparkContext.broadcast(frequencies(docs, words))
    signs = checkpoint(_signatures(docs, kind, words, percent, counts))
    classes = signs.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2", "prefix_hash").agg(F.min("doc_id").alias("class_id"))
    classes = checkpoint(classes.join(classes.groupBy("n", "prefix_hash").agg(F.min("class_id").alias("group_id")), ["n", "prefix_hash"]))
    groups = signs.join(classes.where("class_id = group_id").select("group_id"), F.col("doc_id") == F.col("group_id")).select("group_id", "n", F.posexplode("prefix").alias("at", "token"))
    groups = checkpoint(groups)
    often = checkpoint(groups.groupBy("token").count().where("count > 1").select("token"))  # written: Spark splits a frequent shingle only where both sides of a join are shuffled for it
    groups = checkpoint(groups.join(often, "token"), groups, often)  # only shingles that groups share
    central = checkpoint(groups.groupBy("group_id").agg((F.count("*") / (F.max("n") - F.floor((percent * F.max("n") + 99) / 100) + 1)).alias("central")))  # the shared part of a prefix
    groups = checkpoint(groups.join(central, "group_id"), groups, central)
    leaders = groups.groupBy("token").agg(F.min(F.struct((-F.col("central")).alias("least"), "group_id", "n", "at")).alias("l"))
    leaders = checkpoint(leaders.select("token", *[F.col(f"l.{c}").alias(f"{c}_y") for c in ("group_id", "n", "at")]))
    members = classes.select("class_id", "group_id")

    def near(x: str, y: str) -> Column:
        """Whether two groups can be like, by their sizes and the places of the shared shingle in them."""
        na, nb, i, j = (F.col(c) for c in (f"n{x}", f"n{y}", f"at{x}", f"at{y}"))
        return _enough(percent, na, nb, F.least(i, j) + F.least(na - i, nb - j)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))

    def side(df: DataFrame, x: str, key: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{c}{x}") for c in df.columns if c != key])

    star = groups.join(leaders, "token").withColumnsRenamed({c: f"{c}_x" for c in ("group_id", "n", "at")}).where((F.col("group_id_x") != F.col("group_id_y")) & near("_x", "_y"))
    star = star.select(F.least("group_id_x", "group_id_y").alias("a"), F.greatest("group_id_x", "group_id_y").alias("b"))
    within = members.where("class_id != group_id").select(F.col("group_id").alias("a"), F.col("class_id").alias("b"))
    first_pairs = checkpoint(star.unionByName(within).distinct(), leaders)
    links = _verified(first_pairs, docs, signs, words, percent)
    found = components(links)

    bits = signs.select(F.col("doc_id").alias("class_id"), "n", "bits")
    labels = members.join(found, F.col("class_id") == F.col("id"), "left").select("class_id", "group_id", F.coalesce("component", "class_id").alias("label"))
    labels = checkpoint(labels.join(bits, "class_id"))
    parts = labels.groupBy("group_id").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.when(F.count("*") == 1, F.first("bits")).alias("bits"))
    marked = checkpoint(groups.select("token", "group_id", "n", "at").join(checkpoint(parts), "group_id"), groups)
    mixed_lists = checkpoint(marked.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("token"))
    marked = checkpoint(marked.join(mixed_lists, "token"), marked, mixed_lists)
    differ = "(low_x != low_y or low_x != high_x or low_y != high_y)"
    cross = side(marked, "_x", "token").join(side(marked, "_y", "token"), "token").where((F.col("group_id_x") < F.col("group_id_y")) & F.expr(differ) & near("_x", "_y") & _alike(percent, "_x", "_y"))
    cross = checkpoint(cross.select("group_id_x", "group_id_y").distinct(), marked)
    own = labels.select("group_id", "class_id", "label", "n", "bits")
    unlike = (F.col("label_x") != F.col("label_y")) & _alike(percent, "_x", "_y")
    cross = cross.join(own.select(*[F.col(c).alias(f"{c}_x") for c in own.columns]), "group_id_x").join(own.select(*[F.col(c).alias(f"{c}_y") for c in own.columns]), "group_id_y").where(unlike)
    split = own.join(parts.where("low < high").select("group_id"), "group_id")  # groups whose classes aren't all connected yet
    inner = side(split, "_x", "group_id").join(side(split, "_y", "group_id"), "group_id").where((F.col("class_id_x") < F.col("class_id_y")) & unlike)
    pairs = cross.select("class_id_x", "class_id_y").unionByName(inner.select("class_id_x", "class_id_y")).select(F.least("class_id_x", "class_id_y").alias("a"), F.greatest("class_id_x", "class_id_y").alias("b"))
    more = _verified(pairs.join(first_pairs, ["a", "b"], "left_anti"), docs, signs, words, percent)
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    in_class = signs.join(classes.select("n", "s1", "s2", "class_id"), ["n", "s1", "s2"], "left")
    named = in_class.join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"))


def report(documents: DataFrame) -> DataFrame:
    """Shingles of four words, likeness of 0.85 or more: doc_id, n_shingles, component_id."""
    return near_duplicates(documents, words=4, percent=85).select("doc_id", "n_shingles", "component_id")
