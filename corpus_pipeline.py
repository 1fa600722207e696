"""A training corpus from raw documents: stages that each read all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns their token ids. Between stages the
rows are written as Parquet to the shared folder and read again.

Columns other than doc_id and text are carried as they are, whatever their names
(n_chars, where it is there, follows the text). Null texts are empty texts; an empty
table passes every stage as an empty table.
"""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontamination, jaccard_join, line_dedup, toxicity
from weftline.llm._spark import checkpoint, free, only_kept, table, text_of

ORACLE_SQL = None  # the scores of the first stage are learned


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is a half or more go. Each row is judged by its text alone; null and empty texts stay, null and repeated ids are rows like others."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go from all but the first; a document left without any word by that goes too.

    Each text of an id is a text of its own, and all of them are one document. Rows
    with a null id stay as they are; empty texts stay; rows that repeat stay as often
    as they come.
    """
    left = line_dedup.deduplicate(docs).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "kept", "n_dropped")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own"), F.xxhash64(text_of()).alias("of"))
    rows = rows.join(left, (F.col("own") == F.col("id")) & (F.col("of") == F.col("hash")))
    rows = rows.where((F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    row, changed = F.col("row"), F.col("n_dropped") > 0
    made = {"text": F.when(changed, F.col("kept")).otherwise(row["text"])}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(changed, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    rows = rows.select(*[made.get(c, row[c]).alias(c) for c in docs.columns])
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates stays (five words, likeness of 0.8); rows that repeat an id with the same text are one.

    Where ids repeat each text of an id is judged by itself. Rows with a null id stay,
    and so do texts without words.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("text_hash")) if repeated else F.col("doc_id")
    groups = jaccard_join.near_duplicates(known.select(own.alias("doc_id"), "text"))
    kept = groups.where("component_id is null or component_id = doc_id").select(F.col("doc_id").alias("id"))
    rows = known.select(F.struct(*docs.columns).alias("row"), own.alias("own")).join(kept, F.col("own") == F.col("id"), "left_semi")
    rows = rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    rows = rows.dropDuplicates(["doc_id", "text"]) if repeated else rows
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words or more go. Each row is judged by its own text; null ids are ids like others, and texts without words stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every row; null and empty texts have no ids."""
    ids = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, on documents. A stage's own files are removed when its rows are written, and those when the next one's are; a stage that leaves nothing of a corpus gives a warning."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        with only_kept() as kept:
            made = checkpoint(stage(spark, docs, sf_dir))
            kept.append(made)
        if made.isEmpty() and not docs.isEmpty():
            warnings.warn(f"{name} left nothing of a corpus that was not empty", stacklevel=2)
        if number:
            free(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
