"""DuckDB statements that give the same rows as the contract queries, where SQL can express them.

Tokenizers, trained models and alignment have none; their queries are tested against plain versions.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
win AS (SELECT doc_id, i, n, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS x FROM w),
seen AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM win WHERE i + 12 <= n),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM seen, range(13) AS r(k) WHERE first < doc_id),
marked AS (SELECT w.doc_id, w.i, w.w, gone.i IS NOT NULL AS g FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i),
kept AS (SELECT doc_id, count(*) FILTER (g) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT g) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
win AS (SELECT doc_id, i, n, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM w),
s AS (SELECT DISTINCT doc_id, x FROM win WHERE i + 4 <= n UNION SELECT doc_id, ws FROM d WHERE len(ws) BETWEEN 1 AND 4),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, c AS component_id FROM d LEFT JOIN k USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = d.doc_id
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host, {_WORDS} AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
win AS (SELECT r, i, n, list(w) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM w),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win WHERE i + 4 <= n) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS q(k) GROUP BY r),
lines AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS raw FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY r),
plain AS (SELECT r, host, t, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM lines),
sized AS (SELECT r, host, t, line, CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END AS n FROM plain),
spread AS (SELECT host, line, count(DISTINCT t) AS c FROM sized WHERE n > 0 GROUP BY host, line),
texts AS (SELECT host, count(DISTINCT t) AS c FROM d GROUP BY host),
hot AS (SELECT spread.host, line FROM spread JOIN texts USING (host) WHERE spread.c > 20 AND spread.c > 0.02 * texts.c),
common AS (SELECT r, sum(n) AS n FROM sized SEMI JOIN hot ON hot.host = sized.host AND hot.line = sized.line GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(common.n, 0)::BIGINT AS n_common_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN common USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_common_words >= 10 AND n_words - n_common_words >= 0.2 * n_words AS kept FROM v
"""

OP9 = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op5_substrings": OP5, "op6_jaccard": OP6, "op7_rules": OP7, "op9_neighbours": OP9}
