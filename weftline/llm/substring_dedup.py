"""Removal of repeated word passages by level-wise doubling.

Windows of a short length are looked up across the documents first. Only those that
repeat are extended to twice their length, to the right or, where the passage ends
there, to the left, and looked up again, and so on up to the full passage, which at
last is looked up exactly; a passage whose window does not repeat is no candidate
any more. On the first level not every window is looked up but the one with the
smallest hash in each possible passage: a passage that repeats has the same one in
all its copies, and so the same extensions.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._rolling import SECOND, smallest, spans, windows, word_hashes
from weftline.llm._rows import id_type, one_row_per_id, per_document, signed
from weftline.llm._spark import checkpoint

SPAN = 13
FIRST = 4  # words in a window of the first level


def levels(span: int = SPAN, first: int = FIRST) -> list[int]:
    """The window lengths below the full passage: doubled until the next would reach it."""
    out = [first]
    while 2 * out[-1] < span:
        out.append(2 * out[-1])
    return out


def _starts_by_level(hashes: np.ndarray, span: int, sizes: list[int]) -> list[np.ndarray]:
    """For every passage the start of its window of each of ``sizes``: the window of smallest hash, extended within the passage from level to level."""
    at = smallest(windows(hashes, sizes[0]), span - sizes[0] + 1)
    passage, out = np.arange(len(at)), [at]
    for size in sizes[:-1]:
        left = np.where(at - size >= passage, at - size, passage + span - 2 * size)
        at = np.where(at - passage + 2 * size <= span, at, left)
        out.append(at)
    return out


def _starts(hashes: np.ndarray, span: int, sizes: list[int]) -> np.ndarray:
    """``_starts_by_level`` of the last of ``sizes``."""
    return _starts_by_level(hashes, span, sizes)[-1]


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    """Which of n places are in ``at``."""
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _alive(hashes: np.ndarray, span: int, sizes: list[int], kept: np.ndarray) -> np.ndarray:
    """Which passages (by start) have a kept window on the level of the last of ``sizes``."""
    return _marked(len(hashes), kept)[_starts(hashes, span, sizes)]


def _selected(hashes: np.ndarray, span: int, sizes: list[int], kept: np.ndarray | None) -> list[np.ndarray]:
    """Hashes and places of the windows on the level of the last of ``sizes``, of passages with a kept window on the level before (all on the first)."""
    starts = _starts_by_level(hashes, span, sizes)
    at = starts[-1] if kept is None else starts[-1][_marked(len(hashes), kept)[starts[-2]]]
    at = np.flatnonzero(_marked(len(hashes), at))
    return [signed(windows(hashes, sizes[-1])[at]), at.astype(np.int32)]


def _kept(rows: DataFrame) -> DataFrame:
    """doc_id, kept: the places whose window occurs in two documents or more; the files of rows go.

    Windows are pre-aggregated. Those kept are written, since Spark splits a frequent
    key only where both sides of a join are shuffled for it.
    """
    keys = checkpoint(rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"))
    return checkpoint(rows.join(keys, "key").groupBy("doc_id").agg(F.collect_list("pos").alias("kept")), rows, keys)


def repeated_passages(documents: DataFrame, span: int = SPAN, first: int = FIRST) -> DataFrame:
    """doc_id, starts, counts: runs of places (in words) of passages of ``span`` words that also start in a document of smaller id.

    Of documents only doc_id and text are used. Rows with a null id have no place in
    the order and neither lose nor cause anything; where an id has several rows the
    greatest text stands for it.

    The last level takes runs of neighbouring passages together: in a run that some
    document of smaller id has in the same words, every passage repeats. Only the
    first document of each run is then looked up passage by passage, and only where
    a different run shares its selected window.
    """
    docs, kind = one_row_per_id(documents.where(F.col("doc_id").isNotNull())), id_type(documents)
    sizes = levels(span, first)
    none = np.zeros(0, np.int64)

    def hashed(text: bytes) -> np.ndarray:
        return word_hashes(np.frombuffer(text, np.uint8))

    def level(number: int):
        def one(text: bytes, kept: np.ndarray | None = None):
            h = hashed(text)
            if len(h) < span:
                return [none, none]
            return _selected(h, span, sizes[: number + 1], kept)

        return lambda batches: per_document(batches, one, ["doc_id", "key", "pos"])

    def runs(text: bytes, kept: np.ndarray):
        h = hashed(text)
        alive = np.flatnonzero(_alive(h, span, sizes, kept))
        grams = windows(h, sizes[0])
        at = smallest(grams, span - sizes[0] + 1)[alive]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(alive) != 1) | (np.diff(at) != 0)])) if len(alive) else none
        start, count = alive[new], np.diff(np.append(new, len(alive)))
        words = spans(h, start, start + count + span - 1)
        again = spans(h ^ np.uint64(SECOND), start, start + count + span - 1, 1)
        return signed(grams[at[new]]), signed(words), signed(again), start.astype(np.int32), count.astype(np.int32)

    def passages(text: bytes, starts: np.ndarray, counts: np.ndarray):
        h = hashed(text)
        at = np.repeat(starts, counts) + np.concatenate([np.arange(c) for c in counts])
        return signed(windows(h, span)[at]), signed(windows(h ^ np.uint64(SECOND), span, 1)[at]), at.astype(np.int32)

    rows = checkpoint(docs.mapInArrow(level(0), f"doc_id {kind}, key long, pos int"))
    for number in range(1, len(sizes)):
        kept = _kept(rows)
        rows = checkpoint(docs.join(kept, "doc_id").select("doc_id", "text", "kept").mapInArrow(level(number), f"doc_id {kind}, key long, pos int"), kept)
    names = ["doc_id", "key", "run", "run2", "start", "count"]
    kept = _kept(rows)
    found = docs.join(kept, "doc_id").select("doc_id", "text", "kept")
    found = checkpoint(found.mapInArrow(lambda b: per_document(b, runs, names), f"doc_id {kind}, key long, run long, run2 long, start int, count int"), kept)

    each = checkpoint(found.groupBy("key", "run", "run2").agg(F.min("doc_id").alias("first")))
    shared = checkpoint(each.groupBy("key").count().where("count > 1").select("key")).select("key", F.lit(True).alias("shared"))
    marked = found.join(each, ["key", "run", "run2"]).join(shared, "key", "left")
    marked = checkpoint(marked.where("doc_id > first or shared").select("doc_id", "start", "count", (F.col("doc_id") > F.col("first")).alias("whole")), found, each)
    asked = marked.where("not whole").groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    asked = docs.join(asked, "doc_id").select("doc_id", "text", "starts", "counts")
    single = checkpoint(asked.mapInArrow(lambda b: per_document(b, passages, ["doc_id", "key", "key2", "pos"]), f"doc_id {kind}, key long, key2 long, pos int"))
    least = checkpoint(single.groupBy("key", "key2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    late = single.join(least, ["key", "key2"]).where("doc_id > first").select("doc_id", F.col("pos").alias("start"), F.lit(1).alias("count"))
    late = late.unionByName(marked.where("whole").select("doc_id", "start", "count"))
    return checkpoint(late.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts")), single, marked, least)


def covered(n: int, starts, counts, span: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    if starts is not None:
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + counts + span - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed; one row per id, see ``repeated_passages``.

    Null and empty texts have no words; a row with a null id is kept whole, in a row
    of its own. An empty table gives no rows.
    """
    starts = repeated_passages(documents, span)
    docs = one_row_per_id(documents.where(F.col("doc_id").isNotNull())).join(starts, "doc_id", "left")
    docs = docs.unionByName(documents.where(F.col("doc_id").isNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("counts")))

    def one(text: bytes, starts, counts):
        words = text.split()
        gone = covered(len(words), starts, counts, span)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
        return np.array([kept], object), np.array([len(words)]), np.array([int(gone.sum())])

    return docs.select("doc_id", "text", "starts", "counts").mapInArrow(
        lambda b: per_document(b, one, ["doc_id", "text", "n_words", "n_removed"]), f"doc_id {id_type(documents)}, text binary, n_words long, n_removed long"
    ).withColumn("text", F.col("text").cast("string"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduplicate(documents).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
