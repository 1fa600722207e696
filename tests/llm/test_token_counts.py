import tempfile
from collections import Counter

import numpy as np
import public_tokenizers

from weftline.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(ids, sep):
    at = np.flatnonzero(np.array(ids) == sep)
    return [(k, int(a - (at[k - 1] if k else -1) - 1)) for k, a in enumerate(at)]


def test_blocks(spark):
    rng = np.random.default_rng(0)
    files = {0: [9] * 7, 1: [1] * 50, 2: [], 3: [1] * 30 + [9], 4: rng.integers(7, 10, 200).tolist(), 5: [9] + [1] * 31 + [9] + [2] * 3, 6: [1] * 95 + [9] + [3] * 70 + [9, 9]}
    for sep, form in ((9, "<u2"), (70_000, "<u4")):
        folder, named = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), {}
        for f, ids in files.items():
            named[f"{folder}/{f}.bin"] = ids = [sep if x == 9 else x for x in ids]
            np.array(ids, form).tofile(f"{folder}/{f}.bin")
        df = spark.createDataFrame([(f, "x", 1) for f in [*named, f"{folder}/4.bin", None]], "file string, open string, ends int")
        want = sorted((f, *x) for f, ids in named.items() for x in brute(ids, sep))
        for size, chunk in ((4, 2), (20, 3), (20, 1), (1 << 18, 1024)):
            assert sorted(tuple(r) for r in T.counts(df, sep, size, chunk).collect()) == want
        assert T.counts(df.limit(0), sep).count() == 0


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    enc, _ = T.encoding(PATH)
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in d.collect())
    assert sorted(map(tuple, T.report(d, PATH).collect())) == want
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "a b", 3), (3, "a b", 3), (4, "x " * 60_000, 5)], "doc_id long, text string, file int")
    assert Counter(map(tuple, T.report(odd, PATH).collect())) == Counter([(1, 0), (None, 0), (3, 2), (3, 2), (4, len(enc.encode_ordinary("x " * 60_000)))])
    assert T.report(odd.limit(0), PATH).count() == 0
