"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text becomes a sequence of word hashes. Of each run of ``SPAN - GRAM + 1``
consecutive k-gram hashes the smallest is kept (leftmost on ties), so any two
texts that share ``SPAN`` consecutive words keep one k-gram at the same place of
the shared span. Kept fingerprints of both sides are joined, one row for each of the
document's, and each hit is extended to the left and right to the spans that hold it,
which are looked up among the spans of the items. Items of fewer words are looked up by
their first words in the same pass.

What many items share is joined once: a span of words is one row whatever the number of
its items, items that share spans alike are one set, and sets are turned into items only
for the documents that have them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import checkpoint, free, text_of

SPAN = 13  # words that must agree
GRAM = 5  # words in a fingerprinted k-gram
BROADCAST_ROWS = 500_000  # fingerprints sent to every executor, with at most 13 lengths each: below 50 MB; more are joined by shuffle
MASK_BITS = 1 << 16  # of the bitmap of short items' first words: 8 KB

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z only and splits at ASCII characters that are neither digits nor letters."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _grams(h: str, size: int) -> Column:
    """Packed k-grams: the upper half has 31 bits of the k-gram's hash, the lower half its position."""
    at = lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(size)])
    return F.when(
        F.size(h) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - size),
            lambda i: F.shiftleft(F.shiftrightunsigned(at(i), 33), 32).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _winnowed(packed: str, window: int) -> Column:
    """The smallest packed k-gram of each window of consecutive k-grams, once each."""
    return F.when(
        F.size(packed) >= window,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.size(packed) - (window - 1)),
                lambda i: F.array_min(F.slice(F.col(packed), i, window)),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


FP, POS = F.shiftright, lambda m: F.col(m).bitwiseAND(0xFFFFFFFF).cast("int")
LENGTH_ROW = -1  # the fp of the one row of a text that has its number of words instead of a position


def fingerprints(hashed: DataFrame, h: str, *keys: str, span: int = SPAN, gram: int = GRAM, more: Sequence[Column] = ()) -> DataFrame:
    """(keys, fp, pos): the winnowed fingerprints of rows whose column ``h`` holds word hashes, ``more`` packed ones, and a LENGTH_ROW for each."""
    packed = hashed.select(*keys, F.size(h).cast("long").alias("_n"), _grams(h, gram).alias("_p"), *[c.alias(f"_more{k}") for k, c in enumerate(more)])
    length = F.array(F.lit(LENGTH_ROW << 32).bitwiseOR(F.col("_n")))
    kept = packed.select(*keys, F.explode(F.concat(length, _winnowed("_p", span - gram + 1), *[F.col(f"_more{k}") for k in range(len(more))])).alias("_m"))
    return kept.select(*keys, FP("_m", 32).alias("fp"), POS("_m").alias("pos"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a written table only when its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key(span: Column) -> list[Column]:
    """The two columns by which a span of word hashes is known: 128 bits."""
    return [F.xxhash64(span).alias("key"), F.xxhash64(F.lit(1), F.size(span), span).alias("more_key")]


def _spans(items: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """The distinct spans of items (item_id, b): key, more_key, need (words), item_set; and the sets' members: item_set, item_id.

    Items of fewer than ``span`` words are spans of their own. A set is known by its
    size and two sums of its members' hashes, so no task gathers the items of a span.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("b") - span, F.lit(0)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("b", i + 1, span))).alias("w"))
    each = checkpoint(each.select(*_key(F.col("w")), F.size("w").alias("need"), "item_id").distinct())
    parts = [F.sum(F.xxhash64("item_id", F.lit(k)).bitwiseAND(0xFFFFFFFF)) for k in range(2)]
    spans = each.groupBy("key", "more_key", "need").agg(F.xxhash64(F.count("*"), *parts).alias("item_set"))
    spans = checkpoint(spans)
    one = spans.groupBy("item_set").agg(F.min(F.struct("key", "more_key", "need")).alias("x")).select("item_set", "x.*")
    members = each.join(checkpoint(one), ["key", "more_key", "need"]).select("item_set", "item_id")
    members = checkpoint(members)
    free(each)
    return spans, members


def _marks(items: DataFrame, span: int, gram: int) -> DataFrame:
    """fp, needs (lengths of spans, ``span`` or those of short items) of the fingerprints of items (item_id, b).

    Items of fewer than ``span`` words have the hash of their first two words, or their only one.
    """
    long = fingerprints(items.where(F.size("b") >= span), "b", "item_id", span=span, gram=gram).where(F.col("fp") != LENGTH_ROW)
    head = lambda size: FP(F.get(_grams("b", size), F.lit(0)), 32)
    short = items.where(F.size("b") < span).select(F.when(F.size("b") > 1, head(2)).otherwise(head(1)).alias("fp"), F.size("b").alias("need"))
    each = long.select("fp", F.lit(span).alias("need")).unionByName(short)
    return checkpoint(each.groupBy("fp").agg(F.collect_set("need").alias("needs")))  # ``span`` lengths at most


def _in(table: Column):
    """Whether the bit of a packed gram's hash is set in a bitmap."""

    def known(m: Column) -> Column:
        at = F.shiftright(m, 32).bitwiseAND(MASK_BITS - 1).cast("int")
        return F.call_function("shiftright", F.get(table, F.shiftright(at, 6)), at.bitwiseAND(63)).bitwiseAND(1) == 1

    return known


def _short_starts(marks: DataFrame, span: int) -> list[Column]:
    """Packed grams of column h that can start one of the short items, by a bitmap of MASK_BITS of their hashes; none if there are no short items."""
    found = marks.select("fp", F.explode("needs").alias("need")).where(F.col("need") < span).select((F.col("need") > 1).alias("pair"), F.col("fp").bitwiseAND(MASK_BITS - 1).cast("int").alias("bit"))
    out, bits = [], {False: set(), True: set()}
    for r in found.distinct().collect():  # two bitmaps at most, whatever the number of items
        bits[r.pair].add(r.bit)
    for pair, ones in bits.items():
        if not ones:
            continue
        words = [0] * (MASK_BITS // 64)
        for k in ones:
            words[k // 64] |= 1 << k % 64
        table = F.array(*[F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words])
        out.append(F.filter(_grams("h", 2 if pair else 1), _in(table)))
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Spans of benchmark items in documents.

    documents: doc_id, text; benchmark: item_id, text; other columns are ignored, so
    clashing names do no harm. One row per distinct (doc_id, text), which makes
    repeated rows one document; a null doc_id is an id like any other. Null and
    empty texts have no words. An item of fewer than ``span`` words, but not none,
    is matched whole. Repeated items count once; an item with a null id covers
    words but is in no list. Empty tables give no rows or no hits.

    Returns doc_id, text_hash, n_words, spans (array of start, stop in words: may
    overlap), item_ids (array of strings, sorted).
    """
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(text_of()).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", word_hashes(F.col("w")).alias("b"))
        .distinct()
    )
    items = checkpoint(items)
    spans, members = _spans(items, span)
    marks = _marks(items, span, gram)
    docs = documents.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    hashed = docs.select("doc_id", "text_hash", word_hashes(words(F.col("text"))).alias("h"))

    ours = fingerprints(hashed, "h", "doc_id", "text_hash", span=span, gram=gram, more=_short_starts(marks, span))
    hits = ours.join(_bounded(marks), "fp", "left").where(F.col("needs").isNotNull() | (F.col("fp") == LENGTH_ROW))
    by_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(F.col("fp") == LENGTH_ROW, F.col("pos"))).cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("needs").isNotNull(), F.struct("pos", "needs"))).alias("hits"),  # of a document's places
    )
    by_doc = checkpoint(by_doc)  # all words of all documents are read for this once
    no_spans, no_items = F.array().cast("array<struct<start:int,stop:int>>"), F.array().cast("array<string>")
    none = by_doc.where(F.size("hits") == 0).select("doc_id", "text_hash", "n_words", no_spans.alias("spans"), no_items.alias("item_ids"))

    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    other = {"doc_id": "hit_id", "text_hash": "hit_hash"}
    some = by_doc.where(F.size("hits") > 0)
    worded = docs.join(some.drop("n_words").withColumnsRenamed(other), same).select("doc_id", "text_hash", "hits", word_hashes(words(F.col("text"))).alias("h"))

    def around(hit: Column) -> Column:
        """The spans, start and need, that a hit may be part of."""
        first, last = F.greatest(hit["pos"] - (span - gram), F.lit(0)), F.least(hit["pos"], F.size("h") - span)
        long = F.when(F.array_contains(hit["needs"], span) & (last >= first), F.transform(F.sequence(first, F.greatest(last, first)), lambda i: F.struct(i.alias("start"), F.lit(span).alias("need"))))
        short = F.transform(F.filter(hit["needs"], lambda n: (n < span) & (hit["pos"] + n <= F.size("h"))), lambda n: F.struct(hit["pos"].alias("start"), n.alias("need")))
        return F.concat(F.coalesce(long, F.array().cast("array<struct<start:int,need:int>>")), short)

    each = worded.select("doc_id", "text_hash", "h", F.explode(F.array_distinct(F.flatten(F.transform("hits", around)))).alias("s"))
    each = each.select("doc_id", "text_hash", F.col("s.start").alias("start"), F.col("s.need").alias("need"), *_key(F.slice("h", F.col("s.start") + 1, F.col("s.need"))))
    found = checkpoint(each).join(spans, ["key", "more_key", "need"])
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("need")).alias("stop"))).alias("spans"), F.collect_set("item_set").alias("sets"))
    found = checkpoint(found, items, marks)  # read twice
    named = found.select("doc_id", "text_hash", F.explode("sets").alias("item_set")).join(members, "item_set").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    found = found.join(named.withColumnsRenamed(other), same, "left").select("doc_id", "text_hash", "spans", "item_ids")
    some = some.join(found.withColumnsRenamed(other), same, "left")
    return none.unionByName(some.select("doc_id", "text_hash", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("item_ids", no_items).alias("item_ids")))


def n_hit(spans: Column) -> Column:
    """How many words a list of spans covers."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["stop"] - 1))))).cast("long")


def _judged(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contamination`` with n_hit and contaminated."""
    found = contamination(documents, benchmark).withColumn("n_hit", n_hit(F.col("spans")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more are hit)."""
    return _judged(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns kept, whose own text is not contaminated; see ``contamination`` for the cases."""
    found = _judged(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("bad"), F.col("text_hash").alias("bad_hash"))
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").alias("own"), F.xxhash64(text_of()).alias("own_hash"))
    rows = rows.join(found, F.col("own").eqNullSafe(F.col("bad")) & (F.col("own_hash") == F.col("bad_hash")), "left_anti")
    return rows.select(*[F.col("row")[c].alias(c) for c in documents.columns])
