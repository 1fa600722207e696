import hashlib
import random
import re

import numpy as np

from weftline.llm import substring_dedup as S


def brute(rows, span=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(x for x in words if x is not None):
        for k in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][k : k + span]), i)
    out = []
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - span + 1):
            if i is not None and first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cases(spark):
    assert S.levels() == [4, 8]
    w = [f"w{i}" for i in range(100)]
    rng = random.Random(1)
    rows = [(1, " ".join(w)), (2, "x " + " ".join(w[10:23]) + " y"), (3, " ".join(w[10:22])), (4, None), (5, ""), (6, " ".join(w)), (7, "a b " * 30), (8, "a b\t" * 13), (9, "a " * 200), (10, "b c\n" * 50), (11, "b  c " * 7), (None, " ".join(w))]
    rows += [(20 + k, " ".join(w[rng.randrange(60) :][: rng.randrange(50)]) + " é" * rng.randrange(9)) for k in range(60)]
    rows += [(200 + k, " ".join(rng.choices("abc", k=rng.randrange(120)))) for k in range(40)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, pos int, key string")
    assert got(S.report(df)) == brute(rows)
    assert got(S.report(df.where("doc_id is not null").union(df.where("doc_id is not null")))) == brute([r for r in rows if r[0] is not None])
    assert S.report(df.limit(0)).count() == 0


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    assert sum(r[2] for r in want) > 0
    assert got(S.report(d)) == want


def test_windows_of_a_level_are_extensions_of_the_level_before():
    rng = np.random.default_rng(3)
    for span, first in ((13, 4), (26, 4), (20, 3), (9, 2)):
        h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        sizes = S.levels(span, first)
        passage = np.arange(len(h) - span + 1)
        for k in range(1, len(sizes)):
            before, now = S._starts(h, span, sizes[:k]), S._starts(h, span, sizes[: k + 1])
            assert sizes[k] == 2 * sizes[k - 1]
            assert (passage <= now).all() and (now + sizes[k] <= passage + span).all()
            assert (now <= before).all() and (before + sizes[k - 1] <= now + sizes[k]).all()
        copy = np.concatenate([rng.integers(0, 1 << 63, 50, dtype=np.uint64), h[100:140]])
        for k in range(len(sizes)):
            assert (S._starts(copy, span, sizes[: k + 1])[50:] - 50 == S._starts(h, span, sizes[: k + 1])[100 : 100 + 40 - span + 1] - 100).all()


def test_windows_are_selected_from_starts_taken_once(monkeypatch):
    rng = np.random.default_rng(3)
    h, sizes, calls = rng.integers(0, 1 << 63, 300, dtype=np.uint64), S.levels(), []
    kept = rng.choice(290, 90, replace=False).astype(np.int32)
    want = np.unique(S._starts(h, S.SPAN, sizes)[np.isin(S._starts(h, S.SPAN, sizes[:-1]), kept)])
    monkeypatch.setattr(S, "smallest", lambda *a, f=S.smallest: calls.append(1) or f(*a))
    keys, at = S._selected(h, S.SPAN, sizes, kept)
    assert at.tolist() == want.tolist() and len(keys) == len(at) and len(calls) == 1
