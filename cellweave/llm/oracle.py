"""DuckDB statements for the opN_ queries that SQL can express."""

# Patterns as in the operators' contracts.
_WORDS8 = r"list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _agree(place: str, word: str) -> str:
    """How many of a window's words agree with the document's, counted by i from 0 until one doesn't."""
    return f"coalesce(nullif(list_position(list_transform(range(0, n), lambda i: coalesce(CASE WHEN {place} >= 1 THEN d.w[{place}] END = {word}, false)), false), 0) - 1, n)"


OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS8} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, array_to_string(w[k:k+12], ' ') AS phrase, least(len(w), 13) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k+n-1], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id),
pw AS (SELECT DISTINCT phrase, CAST(n AS BIGINT) AS n, string_split(phrase, ' ') AS w FROM iw WHERE len(list_distinct(string_split(phrase, ' '))) >= 3),
half AS (SELECT DISTINCT unnest([n // 2, n - n // 2]) AS m FROM pw),
dh AS (SELECT doc_id, p, m, array_to_string(w[p:p+m-1], ' ') AS ph FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, half WHERE len(w) >= m)),
cand AS (SELECT DISTINCT doc_id, phrase, n, s FROM (SELECT doc_id, phrase, n, p AS s FROM dh JOIN pw ON dh.m = n // 2 AND ph = array_to_string(w[:n // 2], ' ')
  UNION ALL SELECT doc_id, phrase, n, p - n // 2 + e AS s FROM dh JOIN pw ON dh.m = n - n // 2 AND ph = array_to_string(w[n // 2 + 1:], ' ') CROSS JOIN (VALUES (-1), (0), (1)) v(e))),
met AS (SELECT doc_id, phrase, n, {_agree('s + i', 'pw.w[i + 1]')} AS ahead, {_agree('s + n - 1 - i', 'pw.w[n - i]')} AS b0, {_agree('s + n - i', 'pw.w[n - i]')} AS b1, {_agree('s + n - 2 - i', 'pw.w[n - i]')} AS b2
  FROM cand JOIN d USING (doc_id) JOIN pw USING (phrase, n)),
cls AS (SELECT doc_id, count(DISTINCT phrase) AS n_close FROM met WHERE ahead + b0 >= n - 1 OR ahead + b1 >= n OR ahead + b2 >= n - 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_close, 0) AS n_close
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN cls ON d.doc_id = cls.doc_id
"""


def _spans(kind: str, rank: int, regex: str, group: int, least: int) -> str:
    e = "regexp_extract_all(t, '" + regex.replace("'", "''") + "'"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, s + m AS e FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[:i-1], lambda f: length(f))), 0))) AS s,
      unnest(list_transform(found, lambda f: length(f))) AS m, unnest(list_transform(part, lambda f: length(f))) AS c FROM (
    SELECT doc_id, {e}) AS found, {e}, {group}) AS part, string_split_regex(t, '{regex.replace("'", "''")}') AS gaps FROM d)) WHERE c >= {least}"""


# The same rules as in secret_scan, in the same order.
_RULES = [
    ("assign", r"(?:(?i)(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 30),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
]
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans(k, n, r, g, m) for n, (k, r, g, m) in enumerate(_RULES))}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(k.n, 0) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) k ON k.a = d.doc_id
"""

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS vec_id, b.label AS bl, coalesce(CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.al <> s.bl AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE = {"op12_hard_negatives": OP12, "op10_embedding_dedup": OP10, "op6_ngram_jaccard": OP6, "op8_decontaminate": OP8, "op9_secret_scan": OP9}
