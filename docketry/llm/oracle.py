"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all(" + LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all(" + LOWERED + r", '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS t FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(t) AS n FROM win),
grams AS (SELECT doc_id, i AS pos, n, w[i:i + n - 1] AS t FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT g.doc_id, g.pos, g.n, win.item_id FROM grams g JOIN win ON g.t = win.t),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
occ AS (SELECT doc_id, i AS pos, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
freq AS (SELECT word, count(*) AS n FROM occ GROUP BY word),
places AS (SELECT t, k, coalesce(n, 0) AS n, t[k] AS word FROM (SELECT DISTINCT t, unnest(range(1, len(t) + 1)) AS k FROM win) LEFT JOIN freq ON word = t[k]),
rare AS (SELECT t, arg_min(k, n) AS k FROM places GROUP BY t),
tries AS (SELECT DISTINCT doc_id, t, pos - k + off AS s FROM rare JOIN occ ON word = t[k], unnest(range(-2, 3)) AS v(off)),
near AS (SELECT DISTINCT doc_id, t FROM tries JOIN d USING (doc_id) WHERE len(list_filter(range(1, len(t) + 1), lambda j: s + j + 2 >= 1 AND list_contains(w[greatest(1, s + j - 2):s + j + 2], t[j]))) = len(t)),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN win USING (t) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN nears USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

TOPK = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.row AS q, q.vec_id AS query_id, c.row, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY q ORDER BY score DESC, vec_id, row) QUALIFY row_number() OVER w <= 20
"""

CHAT = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p') AS x,
  replace(replace(replace(role, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p'), chr(10), chr(92) || 'n') AS y,
  greatest(CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4, 1) AS tokens FROM c),
b AS (SELECT *, row_number() OVER w AS n, CAST(sum(tokens) OVER w - tokens AS BIGINT) AS begins, 24 + length(x) + length(y) AS size FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, min(CASE WHEN role = 'system' THEN n END) OVER (PARTITION BY conv_id) AS sys FROM b),
h AS (SELECT *, coalesce(max(CASE WHEN n = sys THEN tokens END) OVER (PARTITION BY conv_id), 0) AS st FROM g),
u AS (SELECT *, (768 - CASE WHEN st <= 512 THEN st ELSE 0 END) // 2 AS unit FROM h),
f AS (SELECT *, CASE WHEN tokens > unit OR n = 1 OR begins // unit <> lag(begins // unit) OVER w OR lag(tokens) OVER w > unit THEN 1 ELSE 0 END AS first FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
nth AS (SELECT *, sum(first) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS win FROM f),
wins AS (SELECT conv_id, win, min(n) AS n, min(begins) AS begins, sum(tokens) AS own, any_value(sys) AS sys, any_value(st) AS st FROM nth GROUP BY conv_id, win),
room AS (SELECT *, coalesce(sys < n AND st <= 512 AND st + own <= 1024, false) AS old FROM wins),
repeats AS (SELECT s.conv_id, sum(t.size) AS chars FROM room s JOIN f t ON s.conv_id = t.conv_id AND t.n < s.n
  AND (s.old AND t.n = s.sys OR t.begins >= s.begins - least(256, 1024 - s.own - CASE WHEN s.old THEN s.st ELSE 0 END)) GROUP BY s.conv_id)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
  CAST(sum(size) + coalesce(any_value(chars), 0) AS BIGINT) AS formatted_chars
FROM f LEFT JOIN repeats USING (conv_id) GROUP BY conv_id
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {ALNUM} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT row_number() OVER () AS item, item_id, list_distinct({ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT count(*) AS docs, sum(len(w)) AS words FROM d WHERE len(w) > 0),
asked AS (SELECT item, unnest(w) AS term FROM b),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, n GROUP BY term),
m AS (SELECT row, doc_id, CAST(10 + (CAST(90 * len(w) AS HUGEINT) * docs) // words AS BIGINT) AS m FROM d, n WHERE len(w) > 0),
scores AS (SELECT item, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (row) GROUP BY item, row, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score
FROM scores JOIN b USING (item) WHERE score > 0 WINDOW o AS (PARTITION BY item ORDER BY score DESC, doc_id, row) QUALIFY row_number() OVER o <= 10
"""

SQL = {
    "op13_ranked_search": RANKED,
    "op3_chat_format": CHAT,
    "op6_exact_topk": TOPK,
    "op4_decontaminate": DECONTAMINATE,
    "op8_ngram_jaccard": JACCARD,
}
