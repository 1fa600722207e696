import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from weftline.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, many int, node string, key string, path string, levels string"
EXTRA = (1, 2, "n", "k", "p", "l")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def digest(r, text):
    return sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))


def tree(nodes):
    """The levels over nodes, as long as there are several."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def brute(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, digest(r, r[1]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([n for *_, n, _ in sorted(langs[x], key=lambda y: y[:3])]) for x in order}
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for k, x in enumerate(order):
        for at, (*_, own, r) in enumerate(sorted(langs[x], key=lambda y: y[:3])):
            siblings = path(trees[x], at) + path(top, k)
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = digest(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in siblings:
                node = sha(a + node + b)
            out.append((r[0], own, trees[x][-1][0], top[-1][0], sha("".join(a + b for a, b in siblings)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def made(sizes, first=0):
    rows = []
    for lang, n in sizes.items():
        rows += [(first + len(rows) + k, f"Text {k} É" if k % 3 else None if k % 2 else "", lang, "s" if k % 5 else None, k if k % 7 else None) for k in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 9}, {"en": 64, "de": 65, None: 1, "": 2}, {"en": 513, "é": 512, "z": 3, **{f"l{k}": 1 + k % 2 for k in range(70)}}])
def test_against_brute_force(spark, sizes):
    rows = made(sizes)
    assert got(M.report(table(spark, rows))) == brute(rows)


def test_more_than_one_block_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = made({"en": 600, "de": 65, "fr": 7})
    assert got(M.report(table(spark, rows))) == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    rows = made({"en": 10, "de": 3}) + made({"en": 10}) + [(None, "A", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None), (3, "other", "en", None, 2), (4, "X" * 100_000, "en", "s", 5)]
    assert got(M.report(table(spark, rows))) == brute(rows)
    assert M.report(table(spark, rows).limit(0)).count() == 0
    assert M.report(table(spark, rows).limit(0)).columns == M.report(table(spark, rows)).columns


def test_a_proof_holds_and_a_changed_one_does_not(spark):
    rows = made({"en": 100, "de": 20})
    for r in M.manifest(table(spark, rows)).collect():
        node, false = r.leaf, sha(r.leaf)
        for s in r.path:
            node, false = sha(s.left + node + s.right), sha(s.left + false + s.right)
        assert node == r.root != false


def test_same_as_sql(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents.collect()]
    want = brute(rows)
    assert got(M.report(documents)) == want
    view = duckdb.connect()
    view.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(view.sql(M.SQL).fetchall(), key=repr) == want
    odd = table(spark, made({"en": 70, None: 3, "z": 1}) + [(None, None, None, None, None), (3, "other", "en", None, 2)]).toPandas()
    view.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM odd")
    assert len(view.sql(M.SQL).fetchall()) == len(odd)
