import sys
from pathlib import Path

import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as P
import test_decontamination
import test_jaccard_join
import test_line_dedup

from weftline.llm import _spark, bpe, toxicity
from weftline.llm._spark import checkpoint


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    one = checkpoint(P.drop_toxic(spark, docs, sf))
    bad = {r.doc_id for r in toxicity.report(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    assert one.columns == docs.columns and set(rows(one)) == set(rows(docs)) - bad and bad

    two = checkpoint(P.drop_recurring_lines(spark, one, sf))
    first, want = test_line_dedup.drops(list(rows(one).items())), {}
    for i, t in rows(one).items():
        all_ = t.split("\n")
        left = [x for x in all_ if i <= first.get(test_line_dedup.masked(x), i)]
        if left == all_ or "\n".join(left).strip(" \t\n\r\v\f"):
            want[i] = "\n".join(left)
    assert two.columns == docs.columns and rows(two) == want != rows(one)
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = checkpoint(P.drop_near_duplicates(spark, two, sf))
    want = {i for i, _, c in test_jaccard_join.brute(list(rows(two).items()), 5, 80) if c == i}
    assert three.columns == docs.columns and set(rows(three)) == want

    four = checkpoint(P.drop_contaminated(spark, three, sf))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {x[0] for x in test_decontamination.brute(list(rows(three).items()), items) if x[-1]}
    assert four.columns == docs.columns and set(rows(four)) == want - dirty

    t = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    last = {r.doc_id: bytes(r.ids) for r in P.encode(spark, four, sf).collect()}
    assert last == {i: t.encode(x) for i, x in rows(four).items()}
    assert {r.doc_id: bytes(r.ids) for r in P.run(spark, sf).collect()} == last


def test_null_and_repeated_ids_lose_no_rows(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    own = lambda k: " ".join(f"w{k}x{chr(97 + j)}" for j in range(20))
    rows = [(None, own(1)), (None, own(2)), (None, own(2)), (None, None), (None, item), (7, own(3)), (7, own(4)), (8, own(5)), (8, item), (9, own(4) + " more")]
    docs = spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, k int")
    left = lambda df: sorted(r.k for r in df.collect())
    assert left(P.drop_recurring_lines(spark, docs, sf)) == list(range(10))
    assert left(P.drop_near_duplicates(spark, docs, sf)) == list(range(9))
    assert left(P.drop_contaminated(spark, docs, sf)) == [0, 1, 2, 3, 5, 6, 7, 9]


def test_a_line_of_two_documents_stays_in_the_first_only(spark, sf):
    long = " ".join(f"w{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(60))
    docs = spark.createDataFrame([(2, f"b\n{long}", "en"), (1, f"{long}\na", "en"), (3, "c", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.text for r in P.drop_recurring_lines(spark, docs, sf).collect()} == {1: f"{long}\na", 2: "b", 3: "c"}


def test_columns_with_clashing_names_and_null_texts(spark, sf):
    names = ["kept", "n_dropped", "_id", "_hash", "_of", "id", "hash", "own", "of", "row", "bad", "bad_hash", "own_hash", "hit_id", "component_id", "text_hash", "at", "score"]
    rows = [(k, t) for k, t in enumerate([None, "", "\n\t", "same line here\n\t", "same line here\n\t", "x " * 30_000, "own words"])]
    docs = spark.createDataFrame([(*r, *[str(r[0])] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    left = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    whole = left(docs)
    assert left(P.drop_toxic(spark, docs, sf)) == whole
    assert left(P.drop_recurring_lines(spark, docs, sf)) == [r for r in whole if r[0] != 4]  # white space alone is left of it
    assert left(P.drop_near_duplicates(spark, docs, sf)) == [r for r in whole if r[0] != 4]
    assert left(P.drop_contaminated(spark, docs, sf)) == whole
    assert P.encode(spark, docs, sf).count() == len(whole)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_every_stage_keeps_most_of_a_corpus_of_any_size(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        sf = f"/root/testdata/{sf}"
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        n = docs.count()
        kept = P.drop_toxic(spark, docs, sf).count()
        assert 0.8 * n < kept < n


def test_a_run_leaves_the_last_rows_alone_and_may_leave_no_document(spark, sf, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(_spark, "shared_dir", lambda s: str(shared))
    shared.mkdir()
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(60).write.parquet(f"{tmp_path}/documents.parquet")
    n = P.run(spark, str(tmp_path)).count()
    assert n > 40 and len(list(shared.iterdir())) == 1
    monkeypatch.setattr(toxicity, "without_toxic", lambda d, labels: d.limit(0))
    with pytest.warns(UserWarning):
        assert P.run(spark, str(tmp_path)).count() == 0
