import gzip
import hashlib
import json
import tempfile
from pathlib import Path

import pytest

from weftline.llm import warc


def brute(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = first.get(p) if i is not None and len(p) >= 100 and first[p] != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    long = "é" * 60
    data = [(k, f"http://x/{k} a\nb", f"<p>{k}</p>" * (k % 40)) for k in range(120)] + [(200, None, long), (201, "u", long), (199, "u", long), (3, "u", "q" * 99), (4, "u", "q" * 99), (300, "u", None), (301, "u", ""), (None, "u", long), (199, "u", long), (400, "u", "WARC/1.1\r\n\r\n" * 9000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in data], "page_id long, url string, html string, payload string, first long")
    folder = tempfile.mkdtemp(dir="/tmp", prefix="spark-")
    got = warc.round_trip(df, folder).drop("payload")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(data)
    sides = list(Path(folder, "members").glob("*.index"))
    assert len(sides) > 3
    for side in sides:
        for row in map(json.loads, side.open()):
            with open(row["archive"], "rb") as f:
                f.seek(row["offset"])
                assert gzip.decompress(f.read(row["length"])).startswith(b"WARC/1.1\r\nWARC-Type: " + row["record_type"].encode())
    assert warc.report(df.limit(0)).count() == 0


def test_pages(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    got = sorted((tuple(r) for r in warc.report(d).collect()), key=repr)
    assert got == brute([(r.page_id, r.url, r.html) for r in d.collect()])


def test_ids_of_other_types(spark):
    rows = [("a/1 é>", "u", "x" * 150), ("", "u", "x" * 150), ("page", "u", "y"), (None, None, "x" * 150), ("b", "u", "x" * 150)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert sorted((tuple(r) for r in warc.report(df).collect()), key=repr) == brute(rows)
    small = spark.createDataFrame([(2, "u", "x" * 150), (1, "u", "x" * 150)], "page_id int, url string, html string")
    assert sorted((r.page_id, r.refers_to) for r in warc.report(small).collect()) == [(1, None), (2, 1)]


def test_an_archive_inflates_piece_by_piece(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    records = [warc.record(k, None, bytes(1) * (50_000 * k), "d", None) for k in range(4)]
    for name, data in (("one", gzip.compress(b"".join(records))), ("many", b"".join(map(gzip.compress, records)))):
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(data)
        assert list(warc._stream(str(path))) == records
    path.write_bytes(gzip.compress(b"".join(records)[:-9]))
    with pytest.raises(ValueError, match="ends within"):
        list(warc._stream(str(path)))
