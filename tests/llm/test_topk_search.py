import math

import duckdb
import numpy as np

from weftline.llm import topk_search as T


def brute(rows, k=5):
    known = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.setdefault(i, []).append([math.floor(256 * x) for x in v])
    flat = [(i, max(v)) for i, v in known.items() if i is not None] + [(None, v) for v in known.get(None, [])]
    out = []
    for i, q in flat:
        if i is not None and i % 50 == 0:
            scored = sorted((-max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), 1 - 2**63), j is None, j or 0) for j, v in flat if j != i)
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def small(monkeypatch):
    for name, n in (("GROUP", 64), ("BUCKET", 16), ("BLOCK", 4)):
        monkeypatch.setattr(T, name, n)


SCHEMA = "vec_id long, embedding array<double>, label int, size int, rows int, place int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)


def test_against_brute_force(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(k, (centres[k % 5] * rng.exponential() + 0.05 * rng.normal(size=8)).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(150)]  # a third of all rows are one vector, some of them queries
    assert got(T.report(table(spark, rows))) == brute(rows)
    unit = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    assert got(T.report(table(spark, unit))) == brute(unit)


def test_cases(spark, monkeypatch):
    small(monkeypatch)
    rows = [(0, [0.5, 0.25]), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (None, [0.5, 0.25]), (None, [0.5, 0.25]), (50, [0.0, 0.0]), (6, []), (7, [0.5, 0.25, 9.0])]
    rows += [(100, [-0.3, -0.001]), (100, [-0.3, -0.001]), (150, [1.0, 0.0]), (150, [0.5, 3.0]), (200, None)]
    assert got(T.report(table(spark, rows))) == brute(rows)
    assert got(T.report(table(spark, rows[:1]))) == [] and T.report(table(spark, rows).limit(0)).count() == 0
    huge = [(k, [1e30 * (k % 3 - 1), 1e20, 3.0 * k]) for k in range(60)] + [(70, [1e300, -1e300, 0.0])]
    assert got(T.report(table(spark, huge))) == brute(huge)
    assert len(got(T.top_k(table(spark, rows), table(spark, [(999, [1.0, 1.0])]), 3))) == 3


def test_bounds_keep_what_they_must_and_leave_out_most():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]  # of like lengths, as in a bucket of many
    p = np.floor(256 * (centres[rng.integers(20, size=1000)] + 0.02 * rng.normal(size=(1000, 16))) * rng.uniform(0.99, 1.01, (1000, 1)))
    p = p[np.argsort(-np.linalg.norm(p, axis=1))]
    bucket = T.Bucket(p, np.linalg.norm(p, axis=1))
    shares, apart = [], 0
    for n in range(200):
        far = n % 3 == 0
        q = np.floor(256 * (centres[n % 20] * (not far) + (1 if far else 0.02) * rng.normal(size=16)))
        scores, length = p @ q, np.linalg.norm(q)
        least = np.sort(scores)[-5]
        found = bucket.candidates(q / length, np.argsort(-np.abs(q))[: T.FOCUS], length, least)
        apart += isinstance(found, slice)
        rows = np.arange(1000)[found]
        assert set(np.flatnonzero(scores >= least)) <= set(rows)
        shares += [] if far else [len(rows) / 1000]
    assert 0 < apart < 67 and np.mean(shares) < 0.2, (apart, np.mean(shares))  # both ways are taken
    assert len(p[bucket.candidates(q / length, np.arange(4), length, 1.01 * length * bucket.length[0])]) == 0


def test_groups_out_of_reach_meet_no_block(spark, monkeypatch):
    small(monkeypatch)
    met = []
    real = T._meet
    monkeypatch.setattr(T, "_meet", lambda a, b, k: met.append(b.select("group").distinct().count()) or real(a, b, k))
    rows = [(k, [1.0, 0.1] if k < 64 else [0.5, 0.04] if k < 128 else [0.001, 0.05]) for k in range(640)]
    assert got(T.report(table(spark, rows))) == brute(rows)
    assert met == [1, 1]  # of ten groups


def test_same_as_sql(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in e.collect()])
    assert got(T.report(e)) == want
    view = duckdb.connect()
    view.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    assert sorted(view.sql(T.SQL).fetchall(), key=repr) == want
