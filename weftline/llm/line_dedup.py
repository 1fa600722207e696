"""Removal of recurring lines by a tree of line templates.

Lines go down a tree of fixed depth: by their number of words, then by their first
``LEADING`` words, a word with a digit counting as the variable field ``<*>``. The
distinct lines of a leaf are laid over each other: a word that most of them have
in its place is constant, any other place is a field. Where half of the words after
the leading ones or more, and CONSTANT at least, are constant, the leaf has a
template, and the lines that have all its constants are of that template. The lines
left over are a group of their own; where lines agree too little to have a template,
they are parted by their word in the most constant place, that of the most frequent
word which some of them lack. So it goes on for SPLITS rounds; lines without a template
then are templates of their own.

A template that recurs across documents is boilerplate; its lines go, but for the
first document's. Lines that are the same but for digits recur from ``MIN_DOCS``
documents on, those of a leaf's template from ``LEAF_DOCS`` on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._rows import one_row_per_text
from weftline.llm._spark import checkpoint

LEADING = 2
CONSTANT = 2
MIN_DOCS = 2
LEAF_DOCS = 3
SPLITS = 4  # rounds in which a leaf's lines are parted
FIELD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"


def spaced(line: Column) -> Column:
    """A line's words with one space between them; most lines are so already."""
    other = F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ") | line.rlike(r"[\x09-\x0D]")
    return F.when(other, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def masked(words: Column) -> Column:
    """A line's words (``spaced``), those with an ASCII digit as FIELD. A line whose words all have a digit has nothing constant: it keeps its words."""
    some = words.rlike("[0-9]") & words.rlike(r"(?<![^\x20])[^\x200-9]++(?![^\x20])")
    return F.when(some, F.regexp_replace(words, r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+", FIELD)).otherwise(words)


def leaf(template: Column) -> Column:
    """The path to a leaf: the number of words and the first LEADING ones."""
    size = F.octet_length(template) - F.octet_length(F.replace(template, F.lit(" "), F.lit(""))) + 1
    return F.concat(size.cast("string"), F.lit(" "), F.substring_index(template, " ", LEADING))


def worded(lines: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, template (the masked words) of those of the lines (doc_id, text_hash, at, line) that have words."""
    some = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    some = some.select("doc_id", "text_hash", "at", spaced(F.col("line")).alias("spaced"))
    return some.select("doc_id", "text_hash", "at", masked(F.col("spaced")).alias("template"))


def leaf_templates(docs: DataFrame, each: DataFrame) -> DataFrame:
    """leaf, template_hash, kind of the distinct lines that have all constants of a template of their leaf; ``kind`` is the template's.

    ``each`` has the distinct lines (leaf, template_hash) with one place (doc_id,
    text_hash, at) of each. Only lines of leaves that have several are read again; a
    line is one row of word hashes, and a leaf's patterns are counted, not collected.
    """
    several = each.groupBy("leaf").agg(F.count("*").alias("many"), F.sum("docs").alias("docs")).where((F.col("many") > 1) & (F.col("docs") >= LEAF_DOCS)).select("leaf")
    several = checkpoint(several)  # written, as below: Spark splits a frequent leaf only where both sides of a join are shuffled for it
    places = each.join(several, "leaf").groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash")).agg(F.collect_list("one.at").alias("wanted"))
    split = docs.select("doc_id", "text_hash", F.split("text", "\n").alias("l")).join(places, ["doc_id", "text_hash"])  # a text is split once, below the join
    read = split.select("doc_id", "text_hash", F.explode(F.transform("wanted", lambda k: F.struct(k.alias("at"), F.get(F.col("l"), k).alias("line")))).alias("x"))
    read = worded(read.select("doc_id", "text_hash", "x.at", "x.line"))
    hashed = F.transform(F.split("template", " "), lambda w: F.xxhash64(w)).alias("words")
    own = F.xxhash64(leaf(F.col("template")))
    lines = checkpoint(read.select(own.alias("leaf"), F.xxhash64("template").alias("template_hash"), own.alias("kind"), hashed), several)
    found = []
    for _ in range(SPLITS):
        decided = checkpoint(_patterns(lines))
        met = lines.join(decided, "kind")
        fits = F.forall("pattern", lambda p: F.get(F.col("words"), p.k) == p.word)
        parted = F.when(F.col("agrees"), F.xxhash64("kind", F.lit("rest"))).otherwise(F.xxhash64("kind", "place", F.get("words", "place")))
        met = checkpoint(met.select("leaf", "template_hash", "kind", "words", (F.col("agrees") & fits).alias("done"), parted.alias("next")), lines, decided)
        found.append(met.where("done").select("leaf", "template_hash", "kind"))
        lines = checkpoint(met.where("not done").select("leaf", "template_hash", F.col("next").alias("kind"), "words"))
        if lines.isEmpty():
            break
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _patterns(lines: DataFrame) -> DataFrame:
    """kind, agrees, pattern (the constants, k and word), place (by which lines that don't agree are parted) of the groups of several lines."""
    many = lines.groupBy("kind").agg(F.count("*").alias("many")).where("many > 1")
    counted = checkpoint(lines.select("kind", F.posexplode("words").alias("k", "word")).groupBy("kind", "k", "word").agg(F.count("*").alias("n")))
    counted = counted.join(checkpoint(many), "kind")
    constant, later, worded_ = 2 * F.col("n") > F.col("many"), F.col("k") >= LEADING, F.col("word") != F.xxhash64(F.lit(FIELD))
    free = later & worded_ & (F.col("n") < F.col("many"))
    each = counted.groupBy("kind").agg(
        (F.max("k") + 1).alias("size"),
        F.sort_array(F.collect_list(F.when(constant, F.struct("k", "word")))).alias("pattern"),  # a word for each place of a line at most
        F.count_if(constant & later & worded_).alias("rest"),
        F.max(F.when(free, F.struct("n", (-F.col("k")).alias("k")))).alias("most"),
    )
    agrees = (F.col("size") > LEADING) & (F.col("rest") >= CONSTANT) & (2 * F.col("rest") >= F.col("size") - LEADING)
    each = each.select("kind", agrees.alias("agrees"), "pattern", (-F.col("most.k")).alias("place"))
    return each.where("agrees or place is not null")


def recurring(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, at of the lines that go. Rows with a null id are no document."""
    own = worded(docs.where("doc_id is not null").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("at", "line")))
    found = checkpoint(own.select("doc_id", "text_hash", "at", F.xxhash64(leaf(F.col("template"))).alias("leaf"), F.xxhash64("template").alias("template_hash")))
    each = found.groupBy("leaf", "template_hash").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash", "at")).alias("one"))
    each = checkpoint(each)
    general = checkpoint(leaf_templates(docs, each))
    alone = each.join(general, ["leaf", "template_hash"], "left_anti").where(F.col("docs") >= MIN_DOCS).select("leaf", "template_hash", "first")
    wide = checkpoint(found.join(general, ["leaf", "template_hash"]).groupBy("kind").agg(F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first")))
    wide = general.join(wide.where(F.col("docs") >= LEAF_DOCS).select("kind", "first"), "kind")
    exact = each.join(general, ["leaf", "template_hash"]).where(F.col("docs") >= MIN_DOCS).select("leaf", "template_hash", "first")  # of templates that are in too few documents
    exact = exact.join(wide.select("leaf", "template_hash"), ["leaf", "template_hash"], "left_anti")
    drop = checkpoint(alone.unionByName(wide.select("leaf", "template_hash", "first")).unionByName(exact))
    return found.join(drop, ["leaf", "template_hash"]).where("doc_id > first").select("doc_id", "text_hash", "at")


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the whole text), kept (the lines left, joined by line feeds), n_lines, n_dropped.

    One row for each text of an id, so rows that repeat an id with the same text are
    one; the texts of one id are one document. Of documents only doc_id and text are
    used. A null text is empty and has one empty line; lines without words are kept;
    a text with a null id is kept whole. An empty table gives no rows.
    """
    docs = one_row_per_text(documents).withColumn("text_hash", F.xxhash64("text"))
    gone = recurring(docs).groupBy("doc_id", "text_hash").agg(F.collect_list("at").alias("gone"))
    each = docs.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", "gone", F.split("text", "\n").alias("l"))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get(F.col("l"), k)), "\n"))
    return each.select("doc_id", "text_hash", kept.alias("kept"), F.size("l").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return deduplicate(documents).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _sql_round(r: int) -> str:
    """One round of SQL's leaves: groups p{r} (kind, template, words) give those that are done, g{r}, and the next groups, p{r + 1}."""
    return rf"""
m{r} AS (SELECT kind, count(*) AS many FROM p{r} GROUP BY kind HAVING count(*) > 1),
c{r} AS (SELECT u.kind AS kind, i, word, many, max(size) AS size, count(*) AS n FROM (SELECT kind, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM p{r}) u JOIN m{r} ON u.kind = m{r}.kind GROUP BY u.kind, i, word, many),
d{r} AS (
  SELECT kind, max(size) AS size, list({{'i': i, 'w': word}}) FILTER (WHERE 2 * n > many) AS pattern, count(*) FILTER (WHERE 2 * n > many AND i > {LEADING} AND word <> '{FIELD}') AS rest,
         arg_max(i, n * 1000000 - i) FILTER (WHERE i > {LEADING} AND word <> '{FIELD}' AND n < many) AS place FROM c{r} GROUP BY kind
), e{r} AS (SELECT *, size > {LEADING} AND rest >= {CONSTANT} AND 2 * rest >= size - {LEADING} AS agrees FROM d{r}),
j{r} AS (SELECT p{r}.*, agrees, place, agrees AND coalesce(list_bool_and(list_transform(pattern, lambda x: words[x.i] = x.w)), true) AS done FROM p{r} JOIN e{r} ON p{r}.kind = e{r}.kind),
g{r} AS (SELECT kind, template FROM j{r} WHERE done),
p{r + 1} AS (SELECT CASE WHEN agrees THEN kind || ' rest{r}' ELSE kind || ' {r}:' || place || ':' || words[place] END AS kind, template, words FROM j{r} WHERE NOT done AND (agrees OR place IS NOT NULL)),"""


SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents
), w AS (SELECT doc_id, k, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
f AS (SELECT *, len(list_filter(words, lambda x: NOT regexp_matches(x, '[0-9]'))) > 0 AS mixed FROM w),
t AS (SELECT doc_id, k, line, CASE WHEN mixed THEN list_transform(words, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) ELSE words END AS words FROM f),
n AS (SELECT *, array_to_string(words, ' ') AS template, concat(len(words), ' ', array_to_string(words[1:{LEADING}], ' ')) AS leaf FROM t),
d AS (SELECT leaf, template, any_value(words) AS words, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM n WHERE template <> '' AND doc_id IS NOT NULL GROUP BY leaf, template),
s AS (SELECT leaf FROM d GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= {LEAF_DOCS}),
p0 AS (SELECT d.leaf AS kind, template, words FROM d JOIN s ON d.leaf = s.leaf),{"".join(map(_sql_round, range(SPLITS)))}
g AS ({" UNION ALL ".join(f"SELECT kind, template FROM g{r}" for r in range(SPLITS))}),
a AS (SELECT g.kind AS kind, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM n JOIN g ON n.template = g.template WHERE doc_id IS NOT NULL GROUP BY g.kind),
r AS (
  SELECT d.template AS rt, CASE WHEN a.docs >= {LEAF_DOCS} THEN a.first WHEN d.docs >= {MIN_DOCS} THEN d.first END AS first
  FROM d LEFT JOIN g ON d.template = g.template LEFT JOIN a ON a.kind = g.kind
), x AS (SELECT n.*, coalesce(doc_id > r.first, false) AS gone FROM n LEFT JOIN r ON template = rt)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
