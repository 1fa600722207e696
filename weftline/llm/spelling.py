"""Spelling variants: words of a corpus at one edit of each other, grouped under their frequent form.

Two words at one edit share the half of a word before it or the half after it. So words
meet by length and half, and a piece of the vocabulary that shares one is a sorted list.
Each word of the list is held against those after it by the edit matrix, of which only
three diagonals matter; the rows of what a listed word shares with the one before it
stay, and where the rows of a prefix exceed one edit all words that share that prefix
are skipped. A piece of more than GROUP words is cut: its words share more than a half,
by where in the rest the edit is, until pieces are small or one place alone is free.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import checkpoint

SHORTEST = 7  # code points
LEAST = 2  # occurrences
DELETED_EVERY = 31
TIMES = 10  # more frequent than a word is its form
GROUP = 2_000
FAR = 9  # stands for any distance above one
LAST = "\U0010ffff"  # after any letter
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: the runs of letters of all texts, with A-Z in lower case, that have SHORTEST code points and LEAST occurrences or more.

    A run loses a code point where its checksum with the row's id divides by
    DELETED_EVERY. Null texts have no runs; a null id is empty in the checksum;
    repeated rows count as often as they come.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{SHORTEST},}})"), 1)).alias("run")
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DELETED_EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def _key(m: Column, a: Column, b: Column) -> Column:
    """What words share whose shorter one has ``m`` code points and whose first ``a`` to ``b`` are equal: those ``a``, and the last ones beyond the edit."""
    return F.xxhash64(m, a, b, F.substring("word", F.lit(1), a), F.right("word", F.greatest(m - 1 - b, F.lit(0))))


def _keyed(words: DataFrame, places: Column) -> DataFrame:
    """A row of words for each of its ``places`` (m, a, b), with the key of it."""
    each = words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*")
    return each.select(_key(F.col("m"), F.col("a"), F.col("b")).alias("key"), "m", "a", "b", "word", "n")


def _place(m: Column, a: Column, b: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def pieces(words: DataFrame) -> DataFrame:
    """The words (word, n) once for each piece (key, m, a, b) that they are in; a piece has GROUP words at most, or one place for its edit."""
    size = F.length("word")
    halves = [_place(m, *ends) for m in (size, size - 1) for h in (F.floor(m / 2),) for ends in ((F.lit(0), h - 1), (h, m))]
    keyed = checkpoint(_keyed(words, F.filter(F.array(*halves), lambda p: p.m >= SHORTEST)))
    done = []
    while True:
        large = keyed.groupBy("key", "m", "a", "b").count().where((F.col("count") > GROUP) & (F.col("b") > F.col("a"))).select("key", "m", "a", "b")
        large = checkpoint(large)  # written: Spark splits a frequent key only where both sides of a join are shuffled for it
        if large.isEmpty():
            done.append(keyed)
            break
        by = ["key", "m", "a", "b"]
        done.append(checkpoint(keyed.join(large, by, "left_anti")))
        middle = F.floor((F.col("a") + F.col("b") + 1) / 2)
        cut = F.array(_place(F.col("m"), F.col("a"), middle - 1), _place(F.col("m"), middle, F.col("b")))
        keyed = checkpoint(_keyed(keyed.join(large, by, "left_semi"), cut), keyed, large)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def shared(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def one_edit(words: list[str], m: int, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in a sorted list of distinct words whose words are at one edit, the shorter one of ``m`` code points, the first ``a`` to ``b`` of them shared.

    A row of the matrix has the distances of a listed word's first ``d`` code points to
    those of the word in hand with one less, as many and one more.
    """
    n = len(words)
    lcp = [0, *(shared(words[k - 1], words[k]) for k in range(1, n)), 0]
    for i in range(n - 1):
        q, k = words[i], i + 1
        size = len(q)
        common = have = lcp[k]
        rows = [(FAR, 0, 1), *[(1, 0, 1)] * have]  # a prefix of q itself needs no work
        if have == size:
            rows[-1] = (1, 0, FAR)
        while k < n and common >= a:
            if common > b:  # no word that shares more is asked for
                k = bisect_right(words, q[: b + 1] + LAST, k)
                common = have = lcp[k]
                continue
            w = words[k]
            del rows[have + 1 :]
            less, same, more = rows[have]
            d, end = have, len(w)
            while d < end:
                c = w[d]
                d += 1
                left = same + 1
                if 1 < d <= size + 1 and (x := less + (q[d - 2] != c)) < left:
                    left = x
                here = right = FAR
                if d <= size:
                    here = min(more, left) + 1
                    if (x := same + (q[d - 1] != c)) < here:
                        here = x
                    if d < size:
                        right = here + 1
                        if (x := more + (q[d] != c)) < right:
                            right = x
                if left > 1 and here > 1 and right > 1:
                    k = bisect_right(words, w[:d] + LAST, k)
                    break
                less, same, more = left, here, right
                rows.append((left, here, right))
            else:
                apart = size - end
                if -1 <= apart <= 1 and (less, same, more)[1 + apart] == 1 and min(size, end) == m:
                    yield i, k
                k += 1
            have = lcp[k]
            if have < common:
                common = have


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (word, near, near_n), both ways, within the pieces of rows that come sorted by piece and word."""

    def links(rows: pa.Table, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
        found = []
        m, a, b = (rows.column(c).to_numpy() for c in ("m", "a", "b"))
        for start, stop in zip(starts, stops, strict=True):
            if stop - start > 1:
                part = rows.slice(start, stop - start)
                words, n = part.column("word").to_pylist(), part.column("n").to_pylist()
                for i, k in one_edit(words, m[start], a[start], b[start]):
                    found += [(words[i], words[k], n[k]), (words[k], words[i], n[i])]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["word", "near", "near_n"])

    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([kept, rows]) if kept is not None else rows
        if not rows.num_rows:
            continue
        turns = np.zeros(rows.num_rows, bool)
        for c in ("key", "m", "a", "b"):
            x = rows.column(c).to_numpy()
            turns[1:] |= x[1:] != x[:-1]
        starts = np.append(0, np.flatnonzero(turns))
        yield links(rows, starts[:-1], starts[1:])  # all but the last piece, which may go on in the next batch
        kept = rows.slice(starts[-1]).combine_chunks()
    if kept is not None:
        yield links(kept, np.array([0]), np.array([kept.num_rows]))


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: each link between words (word, n) at exactly one edit, both ways."""
    by = ["key", "m", "a", "b"]
    return pieces(words).repartition(*by).sortWithinPartitions(*by, "word").mapInArrow(_scan, "word string, near string, near_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root of forms (word, form): the last form that forms lead to. ``most``: the greatest n, of which each form has TIMES its word's."""
    longest, n = 0, LEAST
    while n * TIMES <= most:
        longest, n = longest + 1, n * TIMES
    found = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while steps < longest:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = checkpoint(found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps *= 2
    return found


def variants(documents: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the vocabulary.

    Of documents doc_id and text are used. ``form`` is the near word of largest n (the
    smallest in code-point order on ties), if it has TIMES the word's own n, else null;
    ``root`` is where forms lead, the word itself without one. An empty table gives no
    rows. Very long runs are words like others.
    """
    words = checkpoint(vocabulary(documents))
    links = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(links, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("best"))
    found = checkpoint(found.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), words)
    forms = found.where("form is not null").select("word", "form")
    ends = roots(forms, found.agg(F.max("n")).first()[0] or 0)
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    return variants(documents).select("word", "form", "root", "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
r AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{SHORTEST},}}')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT run, n, list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END) AS s FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(s)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS h FROM b, bits),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {DELETED_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}
), x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (
  SELECT DISTINCT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN w b ON a.cut = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN w b ON a.cut = b.word
), l AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word AS word, w.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM w LEFT JOIN l ON l.word = w.word),
e AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT e.word, f.form, k + 1 FROM e JOIN f ON f.word = e.root WHERE f.form IS NOT NULL)
SELECT f.word AS word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM e GROUP BY word) e ON e.word = f.word
"""
