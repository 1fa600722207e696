import random
import re

import numpy as np

from weftline.llm import jaccard_join as J


def brute(rows, words=4, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None and sets[i]]
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    for a in ids:
        near = {b for s in sets[a] for b in where[s] if b > a}
        for b in near:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def cases():
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, None), (4, ""), (5, "One two"), (6, "one TWO"), (7, "one"), (8, "é É ü ß x"), (9, "é É ü ß x"), (None, " ".join(base))]
    step = list(base)
    for k in range(40):  # a chain whose ends are unlike
        step[(3 * k) % 120] = f"z{k}"
        rows.append((50 - k, " ".join(step)))
    for k in range(60):
        t = [x if rng.random() > 0.02 else "q" for x in base]
        rows.append((100 + k, " ".join(t[rng.randrange(10) :])))
    rows += [(300 + k, " ".join(rng.choices("abc", k=rng.randrange(12)))) for k in range(80)]
    return rows


def test_cases(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, n int, token string").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(J.report(df)) == brute(rows)
    assert got(J.report(df.union(df))) == brute(rows)
    assert J.report(df.limit(0)).count() == 0


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert got(J.report(d)) == brute(rows)
    assert got(J.near_duplicates(d)) == brute(rows, 5, 80)


def test_sketch_never_understates():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 300, 5000):
        for m in (1, 3, 64, 900):
            pool = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n // 3 : n // 3 + m])
            assert J.most_shared(J.sketch(a), J.sketch(b)) >= len(np.intersect1d(a, b))
    heavy = np.arange(1, 1000, dtype=np.uint64) << np.uint64(20)  # all in one bucket, beyond what a byte counts
    assert J.most_shared(J.sketch(heavy), J.sketch(heavy)) >= len(heavy)
    assert J.most_shared(J.sketch(heavy[:400]), J.sketch(heavy)) >= 400
    unlike = [rng.integers(0, 1 << 63, 1000, dtype=np.uint64) for _ in range(2)]
    assert J.most_shared(*map(J.sketch, unlike)) < 800


def test_bitmap_never_overstates_the_difference():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (40, 3), (300, 20), (3000, 250), (3000, 3000)):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + m, dtype=np.uint64))
        a, b = pool[: n + m], pool[m : n + 2 * m]
        bits = sum(int(x).bit_count() for x in (J.parity(a) ^ J.parity(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
    assert J.parity(np.zeros(0, np.uint64)).tolist() == [0] * J.BIT_WORDS


def test_many_classes_of_one_group(spark):
    """Texts that agree in size and prefix but not in the rest, so that one group has to be expanded."""
    rng = random.Random(8)
    often = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(often, k=9))) for k in range(300)]
    rows += [(1000 + k, "rare one here " + " ".join(f"w{(k + j) % 7}" for j in range(12))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.report(df)) == brute(rows)
    assert got(J.near_duplicates(df, 2, 60)) == brute(rows, 2, 60)
