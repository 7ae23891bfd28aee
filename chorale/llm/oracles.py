"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
r AS (SELECT g.doc_id, list(i) AS starts FROM g JOIN m USING (k) WHERE low < g.doc_id GROUP BY g.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 13)))) AS gone FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT u.doc_id, count(*) - count(x.i) AS kept, count(x.i) AS gone, string_agg(word, ' ' ORDER BY u.i) FILTER (WHERE x.i IS NULL) AS t
 FROM u LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM c) x ON u.doc_id = x.doc_id AND u.i = x.i GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

SUFFIXES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, substr(x, 2 * i - 1, 100) AS k FROM (SELECT doc_id, x, unnest(range(1, CAST(length(x) / 2 AS BIGINT) - 48)) AS i FROM h WHERE length(x) >= 100)),
m AS (SELECT k, min(doc_id) AS low FROM g GROUP BY k),
d AS (SELECT g.doc_id, i FROM g JOIN m USING (k) WHERE low < g.doc_id),
b AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 AS fresh FROM d),
s AS (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
e AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS z FROM s GROUP BY doc_id, run),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM e),
j AS (SELECT q.doc_id, sum(z - a + 1) AS n, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept
 FROM q JOIN h USING (doc_id) GROUP BY q.doc_id)
SELECT h.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN j USING (doc_id)
"""

TOP = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
c(n, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.n),
m AS (SELECT n, min(r) AS r FROM c GROUP BY n), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, m.r AS component_id, e.vec_id = m.r AS kept FROM embeddings e JOIN m ON m.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

PREFIXES = """
WITH t AS (SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, length(coalesce(text, '')) AS n, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS r FROM t),
h AS (SELECT DISTINCT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
 lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM t),
b AS (SELECT h.c, k, n, r FROM h JOIN o ON o.c = h.c - h.c % 100 AND r <= h UNION ALL SELECT h.c, k, n, r FROM h JOIN o ON o.c = h.c AND r > h),
g AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY r) AS d FROM b),
p AS MATERIALIZED (SELECT c, d, n, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS key FROM g UNION ALL SELECT c, 0, 0, '' FROM h),
v AS MATERIALIZED (SELECT d, key, min(c) AS c, count(*) AS m, any_value(n) AS n FROM p GROUP BY d, key),
u AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS children FROM v WHERE d > 0 GROUP BY 1),
w AS MATERIALIZED (SELECT v.*, coalesce(children, 0) AS children FROM v LEFT JOIN u USING (key)),
s AS (SELECT key, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT left(key, CAST(32 * unnest(range(0, d + 1)) AS INTEGER)) AS key, (m - 1) * n AS saved, CAST(children = 0 AS INTEGER) AS leaf FROM w) GROUP BY key),
e AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(key, d) AS key FROM p GROUP BY c) GROUP BY key)
SELECT w.c AS conv_id, CAST(w.d AS BIGINT) AS depth, CASE WHEN w.d > 0 THEN x.c END AS parent_conv_id, CAST(w.m AS BIGINT) AS n_convs, CAST(w.children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN s USING (key) LEFT JOIN e USING (key) LEFT JOIN v x ON w.d > 0 AND x.key = left(w.key, 32 * (w.d - 1))
"""

AUDIT = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > low, false)] AS fails,
 coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d JOIN m USING (t) LEFT JOIN l USING (doc_id)),
f AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM c GROUP BY part, fails),
o(filter_order) AS (SELECT '' UNION ALL SELECT concat(filter_order, x) FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, strpos('ABCDE', filter_order[step]) AS own, list_transform(range(1, step), lambda i: strpos('ABCDE', filter_order[i])) AS earlier FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
e AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit, coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false) AS gone,
 list_sum(list_transform(fails, lambda x: CAST(x AS INTEGER))) AS failed FROM f, s),
a AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed, sum(n) FILTER (gone AND hit) AS redundant, sum(n) FILTER (hit AND failed = 1) AS unique_fails,
 sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost FROM e GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
 CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
 CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM a
"""

SQL = {"op11_prefix_trie": PREFIXES, "op13_filter_audit": AUDIT, "op1_substring_dedup": SUBSTRINGS, "op10_suffix_dedup": SUFFIXES, "op4_exact_topk": TOP, "op8_embedding_dedup": VECTORS}
