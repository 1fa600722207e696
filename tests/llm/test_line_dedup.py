import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from weftline.llm import line_dedup as L


def masked(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    digit = [bool(re.search("[0-9]", w)) for w in words]
    return tuple("<*>" if d and not all(digit) else w for w, d in zip(words, digit, strict=True))


def drops(rows):
    """template -> the smallest id of what it recurs with, for templates that go."""
    docs = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and masked(x):
                docs[masked(x)].add(i)
    leaves = defaultdict(list)
    for w in docs:
        leaves[len(w), w[: L.LEADING]].append(w)
    out = {w: min(d) for w, d in docs.items() if len(d) >= 2}
    for ws in leaves.values():
        if len(ws) > 1 and sum(len(docs[w]) for w in ws) >= 3:
            for alike in kinds(ws, L.SPLITS):
                ids = set().union(*(docs[w] for w in alike))
                if len(ids) >= 3:
                    out |= {w: min(ids) for w in alike}
    return out


def kinds(ws, left):
    """The lines of each template of a leaf."""
    if len(ws) < 2 or not left:
        return []
    n = len(ws[0])
    tops = [Counter(col) for col in zip(*ws, strict=True)]
    pattern = [next((w for w, c in top.items() if 2 * c > len(ws)), None) for top in tops]
    rest = sum(w not in (None, "<*>") for w in pattern[L.LEADING :])
    if n > L.LEADING and rest >= 2 and 2 * rest >= n - L.LEADING:
        alike = [w for w in ws if all(p is None or p == x for p, x in zip(pattern, w, strict=True))]
        return [alike] * bool(alike) + kinds([w for w in ws if w not in set(alike)], left - 1)
    free = [(c, -k) for k in range(L.LEADING, n) for w, c in tops[k].items() if w != "<*>" and c < len(ws)]
    if not free:
        return []
    at = -max(free)[1]
    return [x for word in tops[at] for x in kinds([w for w in ws if w[at] == word], left - 1)]


def brute(rows):
    first, out = drops(rows), []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or i <= first.get(masked(x), i)]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cases(spark):
    rows = [(k, f"Page {k} of 9\nown line {'x' * k}\n\nAll rights reserved.  \nid a{k}b") for k in range(1, 8)]
    rows += [(20, None), (21, ""), (22, "All rights\treserved."), (None, "All rights reserved."), (30, "twice\ntwice"), (31, "twice"), (32, "\n" * 5000)]
    df = spark.createDataFrame([(*r, 1, "k", "w", 2) for r in rows], "doc_id long, text string, at int, line string, words string, many int")
    assert got(L.report(df)) == brute(rows)
    assert got(L.report(df.union(df))) == brute(rows)
    assert L.report(df.limit(0)).count() == 0


def test_fields_without_digits(spark):
    rows = [(k, f"Thank you for visiting {city} with us today\nThe weather {city} was {mood}\nown {city}") for k, (city, mood) in enumerate([("Paris", "fine"), ("Rome", "bad"), ("Oslo", "so"), ("Bern", "odd")])]
    rows += [(9, "Thank you for leaving Bern with them now"), (10, "Thank you")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.report(df)) == brute(rows)
    kept = {r.doc_id: r.kept for r in L.deduplicate(df).collect()}
    assert kept[0] == rows[0][1] and kept[1] == "The weather Rome was bad\nown Rome" and kept[9] == rows[4][1]


def test_random_lines_against_brute_force_and_sql(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "d", "e1", "7"]
    rows = [(k if k % 9 else None, "\n".join(" ".join(rng.choices(words, [5, 3, 1, 1, 1, 1], k=rng.randrange(8))) for _ in range(rng.randrange(6)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = [r for r in rows if r[0] is not None]
    assert len({v for v in drops(rows).values()}) > 5
    assert got(L.report(df)) == sorted(set(brute(rows)), key=repr)  # rows without an id that have one text are one
    documents = df.where("doc_id is not null").toPandas()  # noqa: F841
    assert sorted(duckdb.sql(L.SQL).fetchall(), key=repr) == brute(known)


def test_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in d.collect()])
    assert sum(r[2] for r in want) > 0 and got(L.report(d)) == want


def test_every_text_of_null_and_repeated_ids(spark):
    rows = [(None, "All rights reserved."), (None, "other"), (None, None), (1, "All rights reserved.\na"), (1, "All rights reserved.\nb"), (2, "All rights reserved.\nc"), (3, "d\nAll rights reserved."), (3, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.report(df)) == brute(rows)
    assert got(L.report(df.union(df))) == brute(rows)


def test_lines_of_fields_alone_keep_their_values(spark):
    rows = [(k, f"{k}.5 1{k}.7\n2024-01-02\nPage {k}") for k in range(1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.report(df)) == brute(rows)
    assert sorted((r.doc_id, r.kept) for r in L.deduplicate(df).collect()) == [(1, rows[0][1])] + [(k, f"{k}.5 1{k}.7") for k in range(2, 5)]


def test_templates_outlast_unrelated_lines_of_their_leaf(spark):
    rows = [(k, f"Thank you for visiting {x} with us today\nown {x}") for k, x in enumerate(("Paris", "Rome", "Oslo", "Bern"))]
    rows += [(10 + k, f"Thank you my dear old {x} and friends") for k, x in enumerate(("aunt", "dog", "bike", "house"))]
    rows += [(20 + k, f"Thank you {a} {b} {c} {d} {e} {f}") for k, (a, b, c, d, e, f) in enumerate(zip("abcdefgh", "ijklmnop", "qrstuvwx", "ABCDEFGH", "IJKLMNOP", "QRSTUVWX"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.report(df)) == brute(rows)
    kept = {r.doc_id: r.n_dropped for r in L.deduplicate(df).collect()}
    assert [kept[k] for k in range(4)] == [0, 1, 1, 1] and [kept[k] for k in range(10, 14)] == [0, 1, 1, 1] and not any(kept[k] for k in range(20, 28))
    documents = df.toPandas()  # noqa: F841
    assert sorted(duckdb.sql(L.SQL).fetchall(), key=repr) == brute(rows)


def test_templates_of_odd_lines_and_of_long_words(spark):
    lines = ["a b", " a  b1 2 ", "\ta\x0bb\r", "1 2 3", "x\u2028 7", "7\u2028 x7", "é1 é ü", "\u00a01 a\u00a0b", "<*> 1 a", "a1", "q" * 200_000 + " 1"]
    df = spark.createDataFrame([(k, k, 0, x) for k, x in enumerate(lines)], "doc_id int, text_hash long, at int, line string")
    got = L.worded(df.where("line is not null")).select("doc_id", "template", L.leaf(F.col("template")).alias("leaf")).collect()
    want = [(k, masked(x)) for k, x in enumerate(lines)]
    assert sorted(map(tuple, got)) == [(k, " ".join(w), f"{len(w)} {' '.join(w[:2])}") for k, w in want]
