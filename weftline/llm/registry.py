"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from weftline.llm import bpe, decontamination, jaccard_join, line_dedup, merkle, order_minhash, spelling, substring_dedup, suffix_dedup, token_counts, topk_search, toxicity, warc
from weftline.llm._spark import table


def _documents(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_decontamination": lambda s, d: decontamination.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_toxicity": lambda s, d: toxicity.report(table(s, d, "documents"), table(s, d, "labels")),
        "op3_order_minhash": _documents(order_minhash.report),
        "op4_bpe": _documents(lambda t: bpe.report(t, public_tokenizers.path("word_bpe_49k.json"))),
        "op5_suffix_array": _documents(suffix_dedup.report),
        "op6_line_templates": _documents(line_dedup.report),
        "op7_token_counts": _documents(lambda t: token_counts.report(t, public_tokenizers.path("byte_bpe_50k.tiktoken"))),
        "op8_jaccard_join": _documents(jaccard_join.report),
        "op9_substring_doubling": _documents(substring_dedup.report),
        "op10_warc": lambda s, d: warc.report(table(s, d, "pages")),
        "op11_spelling_variants": _documents(spelling.report),
        "op12_merkle_manifest": _documents(merkle.report),
        "op13_topk_search": lambda s, d: topk_search.report(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1,
        "op5_suffix_array": OP5,
        "op6_line_templates": line_dedup.SQL,
        "op8_jaccard_join": OP8,
        "op9_substring_doubling": OP9,
        "op10_warc": OP10,
        "op11_spelling_variants": spelling.SQL,
        "op12_merkle_manifest": merkle.SQL,
        "op13_topk_search": topk_search.SQL,
    }


OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest AS pd, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f ON payload_digest = pd
"""

OP1 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bn AS (SELECT item_id, w, least(len(w), 13) AS size FROM bw WHERE len(w) > 0),
bi AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bn)),
sizes AS (SELECT DISTINCT size FROM bi),
di AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, di.size AS size, item_id FROM di JOIN bi ON di.win = bi.win AND di.size = bi.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT dw.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN ids ON ids.doc_id = dw.doc_id
"""

OP9 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM p JOIN f USING (win) WHERE doc_id > first),
kept AS (
  SELECT a.doc_id AS doc_id, count(*) FILTER (WHERE g.k IS NOT NULL) AS n_removed, string_agg(a.word, ' ' ORDER BY a.k) FILTER (WHERE g.k IS NULL) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w) a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.k = a.k GROUP BY 1)
SELECT w.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP5 = """
WITH t8 AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
h AS (SELECT doc_id, hex(t) AS x FROM t8),
k AS (SELECT doc_id, i, md5(t[i + 1:i + 200]) AS s FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 199)) AS i FROM t8)),
c AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM k SEMI JOIN c USING (s)),
m AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM m GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM r),
t AS (SELECT p.doc_id AS doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS before, max(b) AS rest FROM p JOIN h ON p.doc_id = h.doc_id GROUP BY 1)
SELECT h.doc_id AS doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(before, '') || substr(x, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN t ON h.doc_id = t.doc_id
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a)
SELECT w.doc_id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.root AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT id, min(root) AS root FROM r GROUP BY 1) c ON c.id = w.doc_id
"""
