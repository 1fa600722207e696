import hashlib
import re

from weftline.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(D.UPPER, D.LOWER)


def brute(docs, items):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    out = []
    for i, text in docs:
        w, hit, ids = split(text), set(), set()
        for j, item in items:
            b = split(item)
            if not b:
                continue
            size = min(13, len(b))
            windows = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)}
            at = [k for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in windows]
            if at:
                ids.add(str(j))
                hit.update(x for k in at for x in range(k, k + size))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_cases(spark):
    w = [f"w{i}é" for i in range(60)]
    items = [(1, " ".join(w[:30])), (2, "short ITEM here"), (3, None), (4, "..."), (10, " ".join(w[5:25])), (11, "a " * 40)]
    docs = [
        (1, "x " * 9 + " ".join(w[3:16]) + " y" * 9),
        (2, " ".join(w[3:15])),
        (3, "A Short, item here and short item"),
        (4, None),
        (5, ""),
        (6, "z " * 400 + ", ".join(w)),
        (7, "a " * 12),
        (8, "a " * 500),
        (None, " ".join(w[:14])),
    ]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, item_id int, fp string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(D.report(d, b)) == brute(docs, items)
    assert got(D.report(d.union(d), b)) == brute(docs, items)  # repeated rows are one document
    assert D.report(d.limit(0), b).count() == 0
    assert {r["n_hit"] for r in D.report(d, b.limit(0)).collect()} == {0}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not x[-1] for x in brute(docs, items))


def test_shuffled_benchmark_gives_the_same(spark, sf, monkeypatch):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs, items = [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()]
    want = brute(docs, items)
    assert any(x[-1] for x in want)
    assert got(D.report(d, b)) == want
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert got(D.report(d, b)) == want


def test_short_items_of_every_length(spark):
    w = [f"v{i}" for i in range(40)]
    items = [(n, " ".join(w[n : 2 * n])) for n in range(1, 14)] + [(100 + k, w[k]) for k in (0, 5, 33)] + [(200, "v1 v1"), (201, "v1 v1 v1")]
    docs = [(k, " ".join(w[k:] + ["v1"] * k + w[: 2 * k])) for k in range(25)] + [(90, "v1 v1"), (91, "v5"), (92, "x v33 y")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.report(d, b)) == brute(docs, items)


def test_items_that_share_a_prefix_meet_a_document_once(spark):
    w, n = [f"p{i}" for i in range(40)], 2000
    items = [(k, " ".join([*w, *(f"q{k}a{j}" for j in range(5))])) for k in range(n)] + [(None, " ".join(w))]
    docs = [(k, " ".join(["z"] * k + w + ["y"] * k)) for k in range(3)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = D.report(d, b).collect()
    assert {(r.n_items, r.n_hit, r.contaminated) for r in rows} == {(n, 40, True)}
    assert {r.items_sha256 for r in rows} == {hashlib.sha256(",".join(sorted(map(str, range(n)))).encode()).hexdigest()}
    spans, members = D._spans(b.selectExpr("cast(item_id as string) item_id", "transform(split(text, ' '), w -> xxhash64(w)) b"), 13)
    assert spans.groupBy("key").count().where("count > 1").count() == 0 and members.count() < 15 * (n + 1)


def test_a_short_shared_prefix_does_not_multiply_hits(spark, monkeypatch):
    """As many items as there are share 13 words and differ beyond: a document with these words has one span."""
    w, n = [f"p{i}" for i in range(13)], 3000
    items = [(k, " ".join([*w, *(f"q{k}a{j}" for j in range(20))])) for k in range(n)]
    docs = [(k, " ".join(["z"] * k + w + ["y"] * 100)) for k in range(50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    written = []
    real = D.checkpoint
    monkeypatch.setattr(D, "checkpoint", lambda df, *done: written.append((df.columns, real(df, *done))) or written[-1][1])
    found = D.contamination(d, b)
    counts = {tuple(c): x.count() for c, x in written if hasattr(x, "checkpointed_at") and c[0] == "doc_id"}
    assert counts["doc_id", "text_hash", "start", "need", "key", "more_key"] <= 50 * 30
    assert {(len(r.item_ids), len(r.spans)) for r in found.collect()} == {(n, 1)}
