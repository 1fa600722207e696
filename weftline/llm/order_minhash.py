"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers of words are numbered by occurrence, so the second copy of one is
another k-mer. A fingerprint has CIRCLES independent orders of all numbered k-mers:
their hashes on a circle, hashed anew for each. The slots of a circle are points at
equal distances; each reads the circle from its point onwards, which is an order of
its own (one-permutation hashing with rotation). The ``PICK`` smallest k-mers in a
slot's order are kept, put back into the order of the text and hashed as a tuple.
Slots of two texts agree if the same k-mers come in the same order, so moved text
counts as well as changed text.

Values are packed: the upper 34 bits have the hash, the lower 30 the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm._rows import one_row_per_id
from weftline.llm._spark import checkpoint, partitions

KMER = 3  # words
PICK = 2  # k-mers in a slot's tuple
SLOTS = 32
CIRCLES = 4
PLACE = 30  # bits

SPACE = r"[\x20\x09-\x0D]+"


def _hash_part(x: Column) -> Column:
    return F.shiftright(x, PLACE)


def _place(x: Column) -> Column:
    return x.bitwiseAND((1 << PLACE) - 1)


def _pack(hashed: Column, place: Column) -> Column:
    return F.shiftleft(_hash_part(hashed), PLACE).bitwiseOR(place)


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, an array of SLOTS ints, for column ``text``; a text without words, or null, has zeros.

    A text of fewer than KMER words has one k-mer, all its words. Tuples of a text
    with fewer k-mers than PICK repeat the ones there are.
    """
    kept = df.columns
    h = F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), ""), lambda w: F.xxhash64(w))
    df = df.select(*kept, h.alias("_h"))
    kmer = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(KMER)])
    places = F.sequence(F.lit(0), F.greatest(F.size("_h") - KMER, F.lit(0)))
    df = df.select(*kept, F.when(F.size("_h") > 0, F.sort_array(F.transform(places, lambda i: _pack(kmer(i), i.cast("long"))))).alias("_s"))
    new = lambda i: (i == 0) | (_hash_part(F.get(F.col("_s"), i)) != _hash_part(F.get(F.col("_s"), i - 1)))
    df = df.select(*kept, "_s", F.filter(F.sequence(F.lit(0), F.size("_s") - 1), new).alias("_runs"))
    number = lambda x, nth: _pack(F.xxhash64(_hash_part(x), nth), _place(x))
    run = lambda a, k: F.slice("_s", a + 1, F.coalesce(F.get(F.col("_runs"), k + 1), F.size("_s")) - a)
    numbered = F.when(F.size("_runs") == F.size("_s"), F.transform("_s", lambda x: number(x, F.lit(0)))).otherwise(
        F.flatten(F.transform("_runs", lambda a, k: F.transform(run(a, k), number)))
    )
    df = df.select(*kept, F.sort_array(numbered).alias("_k"))
    again = lambda c: F.sort_array(F.transform("_k0", lambda x: _pack(F.xxhash64(_hash_part(x), F.lit(c)), _place(x))))
    df = df.withColumnRenamed("_k", "_k0")
    circles = [f"_k{c}" for c in range(CIRCLES)]
    df = df.select(*kept, "_k0", *[again(c).alias(circles[c]) for c in range(1, CIRCLES)])
    each = SLOTS // CIRCLES
    points = [(j << 64) // each - (1 << 63) for j in range(each)]  # ascending
    laid = F.array(*[F.lit(p).cast("long") for p in points])
    df = df.select(*kept, *circles, *[F.sort_array(F.concat(k, laid)).alias(f"_with{k}") for k in circles])
    after = lambda k: F.array(*[(F.array_position(f"_with{k}", F.lit(p).cast("long")) - 1 - j).cast("int") for j, p in enumerate(points)])
    df = df.select(*kept, *circles, *[after(k).alias(f"_at{k}") for k in circles])

    def slots(k: str) -> Column:
        def slot(at: Column) -> Column:
            picked = [F.get(F.col(k), F.pmod(at + t, F.size(k))) for t in range(PICK)]
            in_text = F.sort_array(F.array(*[F.shiftleft(_place(x), 34).bitwiseOR(_hash_part(x).bitwiseAND((1 << 34) - 1)) for x in picked]))
            return F.xxhash64(F.transform(in_text, lambda x: x.bitwiseAND((1 << 34) - 1))).bitwiseAND(0x7FFFFFFF).cast("int")

        return F.transform(f"_at{k}", slot)

    zeros = F.array_repeat(F.lit(0), SLOTS)
    return df.select(*kept, F.when(F.col("_k0").isNull(), zeros).otherwise(F.concat(*[slots(k) for k in circles])).alias(out))


def likeness(a: str, b: str) -> Column:
    """The share of slots that agree: 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SLOTS))


def as_text(fingerprint: str) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), ""))


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, next_id: the next id in ascending order (a null id comes first), the first one for the last.

    Ids are split by range, so the order is found within each part; only the parts'
    first ids, as many as there are parts, are put in order together.
    """
    n = partitions(ids.sparkSession)
    parts = checkpoint(ids.select("doc_id").repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("doc_id")
    named = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    firsts = parts.groupBy("part").agg(F.min(named).alias("first"))  # at most n rows
    over = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("then"))
    led = parts.select("doc_id", "part", F.lead(named).over(inside).alias("led"))
    return led.join(F.broadcast(firsts), "part").select("doc_id", F.coalesce("led", "then")["id"].alias("next_id"))


def report(documents: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts.

    The edited text has its last floor(n_chars / 4) code points replaced by as many
    from the start of the next document. One row per id: where an id has several
    rows the greatest text stands for it; a null id is an id, the first one. Null
    texts are empty. A single document is its own next one; an empty table gives no rows.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    docs = fingerprinted(one_row_per_id(documents), "text", "own")
    ids = documents.select("doc_id").distinct()
    sizes = docs.select("doc_id", F.floor(F.char_length("text") / 4).cast("int").alias("take"))
    wanted = sizes.join(successors(ids).withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.col("doc_id").alias("before"), "next_id", "take")
    heads = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("next_id"))).select("before", F.expr("substring(text, 1, take)").alias("head"), F.col("own").alias("next"))
    both = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("before"))).withColumn("n_chars", F.char_length("text"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - CAST(floor(n_chars / 4) AS int))"), F.col("head"))
    both = both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "own", "next", edited.alias("edited"))
    both = fingerprinted(both, "edited", "changed")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
