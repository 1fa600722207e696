import random
import re
import zlib
from collections import Counter

import duckdb

from weftline.llm import spelling as S


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def vocabulary(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words = vocabulary(rows)
    form, out = {}, []
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out.append((w, n, len(close)))
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), n, k, words[form[w]] if form[w] else None) for w, n, k in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edited(rng, w, letters):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])


def test_scan_of_a_list_against_all_pairs():
    rng = random.Random(1)
    for letters in ("ab", "abcé", "abcdefgh"):
        base = ["".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(60)]
        words = sorted({*base, *(edited(rng, w, letters) for w in base * 2)} - {""})
        for m in range(1, 8):
            own = [w for w in words if len(w) in (m, m + 1)]
            want = {(i, k) for i, x in enumerate(own) for k, y in enumerate(own) if i < k and near(x, y) and min(len(x), len(y)) == m}
            assert set(S.one_edit(own, m, 0, m)) == want
            h = m // 2
            parts = [set(S.one_edit(own, m, a, b)) for a, b in ((0, h - 1), (h, m))]
            assert parts[0] | parts[1] == want and not parts[0] & parts[1]


def test_skips_what_shares_a_distant_prefix(monkeypatch):
    words = sorted("abc" + x + y + z for x in "defghij" for y in "klmnopq" for z in "rstuvwx")
    skips = []
    real = S.bisect_right
    monkeypatch.setattr(S, "bisect_right", lambda *a: skips.append(1) or real(*a))
    found = list(S.one_edit(words, 6, 0, 6))
    assert len(found) == len(words) * 18 // 2
    assert len(skips) + len(found) < len(words) ** 2 / 4  # half of all pairs


def pool(rng, n=40):
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(7, 11))) for _ in range(n)]
    return words + [edited(rng, w, "abcdeéÀ") for w in words * 3]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = pool(rng)
    weights = [10 ** rng.uniform(0, 3) for _ in words]
    rows = [(k if k % 11 else None, " ".join(rng.choices(words, weights, k=60)).title() if k % 2 else "-".join(rng.choices(words, weights, k=60))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 5000 + " " + "x" * 5000), (103, "x" * 4999 + " " + "x" * 4999), (5, "straßenbahn STRASSENBAHN straßenbahn")]
    rows.append((6, " ".join(["chainaaa"] * 4 + ["chainaab"] * 50 + ["chainabb"] * 600)))
    df = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, n int, key int")
    want = brute(rows)
    assert sum(x[1] is not None for x in want) > 10 and any(x[2] != x[1] is not None for x in want)
    assert got(S.report(df)) == want
    monkeypatch.setattr(S, "GROUP", 3)  # all pieces of more than three words are cut down
    assert got(S.report(df)) == want
    assert got(S.report(df.union(df))) == brute(rows * 2)
    assert S.report(df.limit(0)).count() == 0


def test_a_third_of_the_words_share_a_half(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 50)
    rng = random.Random(4)
    words = sorted({"prefix" + "".join(rng.choices("abcdefgh", k=4)) for _ in range(700)} | {"".join(rng.choices("abcdefgh", k=3)) + "suffixes" for _ in range(300)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = [(r["count"], r.a, r.b) for r in S.pieces(df).groupBy("key", "m", "a", "b").count().collect()]
    assert max(n for n, a, b in sizes if b > a) <= 50
    want = sorted((x, y, 2) for x in words for y in words if near(x, y))
    assert want and got(S.near_words(df)) == want


def test_roots_follow_forms_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(7)] + [("a", "w3")], "word string, form string")
    assert got(S.roots(forms, 2 * 10**7)) == [("a", "w7"), *((f"w{k}", "w7") for k in range(7))]


def test_same_as_sql(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert got(S.report(documents)) == want
    view = duckdb.connect()
    view.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(view.sql(S.SQL).fetchall(), key=repr) == want
