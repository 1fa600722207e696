import hashlib
import random
import struct

import xxhash

from weftline.llm import order_minhash as M


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, then = t or "", rows[(k + 1) % len(rows)][1] or ""
        out[i] = (len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + then[: len(t) // 4]).encode()).hexdigest())
    return out


def check(df, rows):
    got = {r.doc_id: r for r in M.report(df).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == edited(rows)
    same = {}
    for i, t in rows:
        same.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    return got


def test_cases(spark):
    w = [f"w{k}" for k in range(400)]
    rows = [(1, "a𝄞b" * 50), (5, None), (3, ""), (None, "x y"), (9, "one"), (7, "a b " * 300), (8, "a b " * 300), (12, " ".join(w)), (13, " ".join(w[200:] + w[:200])), (14, " ".join(reversed(w))), (15, "last")]
    df = spark.createDataFrame([(*r, [1], 2) for r in rows], "doc_id long, text string, own array<int>, take int")
    got = check(df, rows)
    assert got[12].near_next > 0.3 and got[13].near_next < 0.1  # moved halves keep most order, a reversed text none
    assert len(check(df.union(df), rows)) == len(rows)
    assert M.report(df.limit(0)).count() == 0
    assert len(check(df.where("doc_id = 12"), [r for r in rows if r[0] == 12])) == 1


def brute(text):
    """The k-mers that two slots' tuples are made of, from the definition."""
    w = text.split()
    seen, out = {}, []
    for k in range(max(1, len(w) - M.KMER + 1)):
        g = tuple(w[k : k + M.KMER])
        seen[g] = seen.get(g, -1) + 1
        out.append((g, seen[g]))
    return out


def test_slots_follow_the_weighted_jaccard(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = check(d, rows)
    near = sum(r.near_edited for r in got.values()) / len(got)
    far = sum(r.near_next for r in got.values()) / len(got)
    assert near > 0.25 and far < 0.1
    share, seen = 0.0, 0.0
    for k, (i, t) in enumerate(rows):
        n, then = len(t), rows[(k + 1) % len(rows)][1]
        a, b = set(brute(t)), set(brute(t[: n - n // 4] + then[: n // 4]))
        share += (len(a & b) / len(a | b)) ** 2 / len(rows)
        seen += got[i].near_edited / len(rows)
    assert abs(share - seen) < 0.05


def chained(*values):
    """The 64-bit hash of texts and long integers, each seeded with the one before it, as a signed integer."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def fingerprint(text):
    """The fingerprint from its definition: per slot the k-mers next on the circle, in the order of the text."""
    words = [chained(w.encode()) for w in text.split()]
    if not words:
        return "0" * 8 * M.SLOTS
    low = lambda x: x >> M.PLACE
    grams = [low(chained(*words[k : k + M.KMER])) for k in range(max(1, len(words) - M.KMER + 1))]
    numbered, seen = [], {}
    for at, g in enumerate(grams):
        nth = seen[g] = seen.get(g, -1) + 1
        seed = xxhash.xxh64_intdigest(struct.pack("<i", nth), chained(g) % (1 << 64))
        numbered.append((low(seed - (1 << 64) if seed >> 63 else seed), at))
    out, each = [], M.SLOTS // M.CIRCLES
    for c in range(M.CIRCLES):
        circle = numbered
        if c:
            seeded = lambda h: xxhash.xxh64_intdigest(struct.pack("<i", c), chained(h) % (1 << 64))
            circle = [(low(s - (1 << 64) if (s := seeded(h)) >> 63 else s), at) for h, at in numbered]
        circle = sorted(circle)
        for j in range(each):
            point = ((j << 64) // each - (1 << 63)) >> M.PLACE
            start = next((k for k, (h, at) in enumerate(circle) if h >= point), 0)
            picked = sorted((circle[(start + t) % len(circle)] for t in range(M.PICK)), key=lambda x: (x[1], x[0] % (1 << 34)))
            out.append(chained(*(h % (1 << 34) for h, _ in picked)) & 0x7FFFFFFF)
    return "".join(f"{x:08x}" for x in out)


def test_short_texts_have_more_slots_than_k_mers(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)))], "doc_id long, text string")
    own = M.report(df).first().fingerprint
    assert len({own[8 * j : 8 * j + 8] for j in range(M.SLOTS)}) > 10  # ten k-mers, in each of the circles


def test_fingerprints_against_the_definition(spark, sf):
    rng = random.Random(9)
    texts = ["", "one", "a b", "a b c", "a b a b a b a b", "x " * 300, "  \t lead", *(" ".join(rng.choices("abcdef", k=rng.randrange(60))) for _ in range(60))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in M.report(df).collect()}
    share = lambda a, b: sum(a[8 * j : 8 * j + 8] == b[8 * j : 8 * j + 8] for j in range(M.SLOTS)) / M.SLOTS
    for k, t in enumerate(texts):
        then = texts[(k + 1) % len(texts)]
        own, changed = fingerprint(t), fingerprint(t[: len(t) - len(t) // 4] + then[: len(t) // 4])
        assert got[k] == (own, changed, share(own, changed), share(own, fingerprint(then)))
