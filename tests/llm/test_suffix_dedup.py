import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import suffix_dedup as S


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows, span=200):
    count = Counter(d[k : k + span] for _, t in rows for d in [(t or "").encode()] for k in range(len(d) - span + 1))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for k in range(len(d) - span + 1):
            if count[d[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        runs = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    base, hot = text(1500), text(230)
    rows = [(1, base), (2, base), (3, text(50) + base[100:300] + text(50)), (4, base[100:299]), (5, None), (6, ""), (7, "a" * 199), (8, "b" * 200), (9, "c" * 201), (10, "xy" * 300), (None, text(20) + base[700:1000])]
    rows += [(20 + k, text(rng.randrange(300)) + hot + text(rng.randrange(300))) for k in range(40)]
    rows += [(100 + k, base[: 400 + 7 * k] + text(3) + base[403 + 7 * k :]) for k in range(20)]
    return rows


def test_cases(spark, monkeypatch):
    rows = cases()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, start int, key string")
    assert got(S.report(df)) == brute(rows)
    assert got(S.report(df.union(df))) == brute(rows)
    assert S.report(df.limit(0)).count() == 0
    few = S.repeated_strings(df, block=3)  # keys of more than three stretches are cut down by range, and split
    all_ = S.repeated_strings(df)
    places = lambda x: sorted((str(r.doc_id), p) for r in x.collect() for a, b in zip(r.starts, r.stops, strict=True) for p in range(a, b))
    assert sorted(set(places(few))) == sorted(set(places(all_)))


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    assert sum(r[2] for r in want) > 0
    assert got(S.report(d)) == want


def test_a_frequent_passage_among_different_surroundings(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    hot = text(320)
    rows = [(k, text(rng.randrange(150, 300)) + hot[rng.randrange(40) :] + text(rng.randrange(150, 300))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (4, 40, 1000):
        places = S.repeated_strings(df, block=block)
        found = {r.doc_id: len({p + k for a, b in zip(r.starts, r.stops, strict=True) for p in range(a, b) for k in range(S.SPAN)}) for r in places.collect()}
        assert {r[0]: r[2] for r in want if r[2]} == found


def test_shared_parts():
    rng = random.Random(1)
    for _ in range(200):
        gram = "G" * 5
        sides = [("".join(rng.choices("ab", k=rng.randrange(8))), "".join(rng.choices("ab", k=rng.randrange(8)))) for _ in range(rng.randrange(2, 7))]
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        got = S.shared_parts([(a + gram + b).encode() for a, b in sides], [len(a) for a, _ in sides], 5)
        for k, (a, b) in enumerate(sides):
            rest = sides[:k] + sides[k + 1 :]
            before, after = max(common(a[::-1], x[::-1]) for x, _ in rest), max(common(b, y) for _, y in rest)
            assert got[k] == (len(a) - before, len(a) + 5 + after)
