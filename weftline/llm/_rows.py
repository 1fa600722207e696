"""How operators that shuffle by doc_id see the documents table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import text_of


def one_row_per_id(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty). Where an id has several rows, the greatest text stands for it.

    Ids are counted first, without texts; texts are grouped only if some id repeats.
    """
    docs = documents.select("doc_id", text_of().alias("text"))
    if documents.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.max("text").alias("text"))


def one_row_per_text(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), once for each text that an id, or no id, has.

    Ids are counted first, without texts; texts are grouped only if some id repeats.
    """
    docs = documents.select("doc_id", text_of().alias("text"))
    if documents.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.distinct()


def id_type(documents: DataFrame) -> str:
    return documents.schema["doc_id"].dataType.simpleString()


BATCH_ROWS = 200_000


def per_document(batches, f, names: list[str]):
    """Turn the rows that ``f`` makes of each document into record batches, the document's id first.

    ``f`` takes the row's other columns (text as bytes, lists as numpy arrays) and
    returns numpy columns of one length.
    """
    for b in batches:
        ids, made, which, n = b.column(0), [], [], 0
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in b.columns[1:]]
        for k in range(b.num_rows):
            row = [x.as_py() if pa.types.is_binary(x.type) or pa.types.is_primitive(x.type) else np.asarray(x.values) if x.is_valid else None for x in (c[k] for c in columns)]
            cols = f(*row)
            if len(cols[0]):
                made.append(cols)
                which.append((k, len(cols[0])))
                n += len(cols[0])
            if n >= BATCH_ROWS or n and k + 1 == b.num_rows:
                at = np.repeat([x for x, _ in which], [x for _, x in which])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(np.concatenate(c)) for c in zip(*made, strict=True))], names)
                made, which, n = [], [], 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
