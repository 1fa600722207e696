"""The helpers the operators share, and the SQL that stands beside them."""

import re
import tempfile

import duckdb
import numpy as np
import pytest
import test_jaccard_join
import test_suffix_dedup

from weftline.llm import _rolling as R
from weftline.llm import _rows, _spark, registry


def test_equal_windows_have_equal_hashes_and_others_do_not():
    rng = np.random.default_rng(1)
    for size in (1, 3, 13):
        values = R.BYTES[rng.integers(97, 100, 500)]
        seen = {}
        for k, h in enumerate(R.windows(values, size).tolist()):
            seen.setdefault(values[k : k + size].tobytes(), set()).add(h)
        assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen)
    starts = rng.integers(0, 400, 50)
    stops = starts + rng.integers(1, 90, 50)
    for a, z, h in zip(starts, stops, R.spans(values, starts, stops), strict=True):
        assert h == R.spans(values[a:z], np.array([0]), np.array([z - a]))[0]
    assert len(R.windows(values[:2], 3)) == 0


def test_smallest_is_the_leftmost_least_of_each_window():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 5, 60).astype(np.uint64) << np.uint64(32)
    for window in (1, 2, 7, 60):
        want = [k + int(np.argmin(h[k : k + window])) for k in range(len(h) - window + 1)]
        assert R.smallest(h, window).tolist() == want
    assert len(R.smallest(h, 61)) == 0


def test_words_are_those_between_white_space():
    for text in ("", " ", "a", " a\tbc\r\n d\x0be\x0cé ", "x" * 1000):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, stops = R.word_bounds(data)
        assert [text.encode()[a:z] for a, z in zip(starts, stops, strict=True)] == [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        assert len(R.word_hashes(data)) == len(starts)
    same = [R.word_hashes(np.frombuffer(t, np.uint8), lowered=True)[0] for t in (b"AbC", b"abc")]
    assert same[0] == same[1]


def test_rows_by_id_and_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (None, "x"), (None, "y")], "doc_id long, text string")
    assert sorted(map(tuple, _rows.one_row_per_id(df).collect()), key=repr) == [(1, "b"), (2, ""), (None, "y")]
    assert sorted(map(tuple, _rows.one_row_per_text(df).collect()), key=repr) == [(1, "a"), (1, "b"), (2, ""), (None, "x"), (None, "y")]


def test_checkpoints_are_written_to_the_shared_folder_and_freed(spark, monkeypatch):
    import os

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    monkeypatch.setattr(_spark, "shared_dir", lambda s: folder)
    one = _spark.checkpoint(spark.range(10))
    assert one.checkpointed_at.startswith(folder) and one.count() == 10
    two = _spark.checkpoint(one.where("id > 3"), one)
    assert two.count() == 6 and len(os.listdir(folder)) == 1
    assert spark.conf.get(_spark.FREE_SHUFFLES) == "false"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _spark.shared_dir(Session())


@pytest.mark.parametrize("name, brute", [("op5_suffix_array", test_suffix_dedup.brute), ("op8_jaccard_join", test_jaccard_join.brute)])
def test_sql_against_brute_force(sf, name, brute):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rows = c.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(c.execute(registry.oracle_sql()[name]).fetchall(), key=repr) == brute(rows)
