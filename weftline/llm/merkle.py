"""A manifest of a table of documents: a Merkle tree for each language, and one over their roots.

Each document is a leaf, the digest of its columns. Leaves are numbered within their
language in the order of doc_id and cut into aligned blocks of FAN ** LEVELS. A block
keeps each of its levels as one string of digests in hex, laid end to end: fixed-width
substrings of a level, FAN digests long, are hashed to the level above it, and what
stands on either side of a digest in its substring are its siblings, a segment of its
proof. The roots of the blocks are the leaves of the next round's blocks, until each
language has one; the languages' roots are the leaves of one more tree of that kind.
Proofs are put together from the top down, a join of blocks with their own proofs for
each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._spark import checkpoint, free
from weftline.operators.ordered import numbered

FAN = 8
LEVELS = 3
BLOCK = FAN**LEVELS
HEX = 64  # characters of a digest
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and itself; ``-`` for null."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    """The digest of a row of documents with this text, in hex."""
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def lowered(text: Column) -> Column:
    """A text with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def _levels(blocks: DataFrame) -> DataFrame:
    """Blocks (key, block, many, items) with ``levels``: the string of each level, from the leaves to the block's root.

    Where a key has no other block its levels end with the first of one digest; it is
    repeated for those that other blocks have above it.
    """
    made = blocks.withColumn("_0", F.array_join(F.transform("items", lambda x: F.lower(F.hex(x.node))), ""))
    for k in range(LEVELS):
        level = F.col(f"_{k}")
        made = made.withColumn(f"_{k + 1}", F.when(_goes_on(level), _parents(level)).otherwise(level))
    return made.select("key", "block", "many", "items", F.array(*[f"_{k}" for k in range(LEVELS + 1)]).alias("levels"))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FAN * HEX)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "")


def _goes_on(level: Column) -> Column:
    """Whether a level of a block is hashed to another one: several digests, or other blocks beside it."""
    return (F.col("many") > BLOCK) | (F.length(level) > HEX)


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round over nodes (key, place, many, node, and what else is carried), and the one node of each key (key, node)."""
    most = nodes.agg(F.max("many")).first()[0]
    rounds = []
    while most is not None and (most > 1 or not rounds):
        carried = [c for c in nodes.columns if c not in ("key", "many")]
        own = nodes.groupBy("key", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.max("many").alias("many"), F.sort_array(F.collect_list(F.struct("place", "node", *[c for c in carried if c not in ("place", "node")]))).alias("items"))  # BLOCK nodes at most
        rounds.append(checkpoint(_levels(own)))
        nodes = rounds[-1].select("key", F.col("block").alias("place"), F.ceil(F.col("many") / BLOCK).alias("many"), F.unhex(F.element_at("levels", -1)).alias("node"))
        most = -(-most // BLOCK)
    return rounds, nodes.select("key", "node")


def _siblings(levels: Column, place: Column) -> Column:
    """The siblings of a block's node on the levels of the block, those on its left and on its right at each level."""
    found = []
    for k in range(LEVELS):
        level = F.get(levels, F.lit(k))
        run = F.substring(level, F.floor(place % BLOCK / FAN ** (k + 1)).cast("int") * (FAN * HEX) + 1, F.lit(FAN * HEX))
        off = F.floor(place % BLOCK / FAN**k).cast("int") % FAN * HEX
        found.append(F.when(_goes_on(level), F.struct(F.substring(run, F.lit(1), off).alias("left"), F.substring(run, off + HEX + 1, F.lit(FAN * HEX)).alias("right"))))
    return F.array_compact(F.array(*found))


def _with_paths(upper: Column) -> Column:
    """A block's items, each with its siblings within the block and then those above the block."""
    return F.transform("items", lambda x: F.struct(x.alias("item"), F.concat(_siblings(F.col("levels"), x.place), F.coalesce(upper, F.array().cast(PATH))).alias("path")))


def _proofs(rounds: list[DataFrame], top: DataFrame | None) -> DataFrame:
    """The nodes of the first round's blocks with ``path``, their siblings up to the top, and what ``top`` (key, block 0, path) carries."""
    above = top
    for blocks in reversed(rounds):
        items = blocks if above is None else blocks.join(above, ["key", "block"])
        upper = F.lit(None).cast(PATH) if above is None else F.col("path")
        more = [c for c in items.columns if c not in ("key", "block", "many", "items", "levels", "path")]
        opened = items.select("key", F.explode(_with_paths(upper)).alias("x"), *more)
        last = blocks is rounds[0]
        above = opened.select("key", "x.item.*" if last else F.col("x.item.place").alias("block"), "x.path", *more)
    return above


def proof_hash(path: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s.left, node, s.right), 256))


def manifest(documents: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, path (the siblings of each level, left and right of the node), one row for each row of documents.

    Of documents doc_id, source, lang, n_chars and text are used. Null langs are a
    language, the first one; nulls of other columns are hashed as such. Rows that
    repeat an id have the order of their leaves, those without an id come first. An
    empty table gives no rows. ``carry``: more columns of the result, made of those of
    documents.
    """
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))  # null is before all others
    leaves = documents.select(key.alias("key"), "doc_id", F.unhex(leaf(F.col("text"))).alias("node"), *[v.alias(k) for k, v in carry.items()])
    placed = checkpoint(numbered(leaves, ["key"], [F.col("doc_id").asc(), F.col("node").asc()]))
    rounds, tops = _rounds(placed)
    free(placed)
    if not rounds:
        tree = placed.sparkSession.createDataFrame([], f"key string, root string, subroot string, path {PATH}")
        none = documents.limit(0).select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), *[v.alias(k) for k, v in carry.items()])
        return none.crossJoin(tree).select("doc_id", "lang", "leaf", "subroot", "root", "path", *carry)  # no rows on either side
    high, root = _rounds(checkpoint(numbered(tops.withColumnsRenamed({"key": "branch"}), [], [F.col("branch").asc()]).withColumn("key", F.lit(""))))
    root = F.lit(root.first()["node"].hex())
    branches = _proofs(high, None).select(F.col("branch").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.lower(F.hex("node")).alias("subroot"))
    found = _proofs(rounds, branches)
    lang = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30))
    return found.select("doc_id", lang.alias("lang"), F.lower(F.hex("node")).alias("leaf"), "subroot", root.alias("root"), "path", *carry)


def tampered() -> Column:
    """Whether crc32 of an id in decimals divides by three; ids that are null are never tampered with."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each leaf held against the root by its proof, a third of them with their text in lower case."""
    low = lowered(F.col("text"))
    other = F.when(tampered() & (F.col("text") != low), F.unhex(leaf(low)))
    found = manifest(documents, {"other": other})
    start = F.coalesce(F.lower(F.hex("other")), F.col("leaf"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), folded(start, F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = f"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, text,
         concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head
  FROM documents
), c AS (
  SELECT row, doc_id, coalesce('=' || lang, '-') AS key, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) AS low,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: xor(s // 256, t[xor(s % 256, b) + 1]))) AS crc
  FROM d, bits
), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS many FROM c),
lv AS (
  SELECT key, 0 AS h, place, many, leaf AS node FROM o
  UNION ALL SELECT key, h + 1, place // 8, (many + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM lv WHERE many > 1 GROUP BY key, h, place // 8, many
), sub AS (SELECT key, node, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS many FROM lv WHERE many = 1),
top AS (
  SELECT 0 AS h, place, many, node FROM sub
  UNION ALL SELECT h + 1, place // 8, (many + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE many > 1 GROUP BY h, place // 8, many
), depth AS (SELECT key, max(h) AS deep FROM lv GROUP BY key),
seg AS (
  SELECT key, h, place, coalesce(string_agg(node, '') OVER (PARTITION BY key, h, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (PARTITION BY key, h, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM lv WHERE many > 1
), high AS (
  SELECT h, place, coalesce(string_agg(node, '') OVER (PARTITION BY h, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (PARTITION BY h, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM top WHERE many > 1
), path AS (
  SELECT row, seg.h AS k, l, r FROM o JOIN seg ON o.key = seg.key AND seg.place = o.place // CAST(pow(8, seg.h) AS BIGINT)
  UNION ALL SELECT row, deep + high.h, l, r FROM o JOIN depth USING (key) JOIN sub ON sub.key = o.key JOIN high ON high.place = sub.place // CAST(pow(8, high.h) AS BIGINT)
), proof AS (SELECT row, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM path GROUP BY row),
fold AS (
  SELECT row, 0 AS k, CASE WHEN crc % 3 = 0 AND text IS NOT NULL THEN low ELSE leaf END AS node FROM o JOIN d USING (row)
  UNION ALL SELECT fold.row, fold.k + 1, sha256(l || node || r) FROM fold JOIN path ON path.row = fold.row AND path.k = fold.k
), ends AS (SELECT row, arg_max(node, k) AS f FROM fold GROUP BY row)
SELECT o.doc_id AS doc_id, o.leaf AS leaf, sub.node AS subroot, (SELECT node FROM top WHERE many = 1) AS root, coalesce(p, sha256('')) AS proof_sha256, f AS folded_root,
       f = (SELECT node FROM top WHERE many = 1) AS verified
FROM o JOIN sub ON sub.key = o.key JOIN ends ON ends.row = o.row LEFT JOIN proof ON proof.row = o.row
"""
