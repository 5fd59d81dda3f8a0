"""DuckDB SQL of the registered queries, written from the tables up and apart from the Spark code."""

from docketry.functions.text import LETTER_STEMS, NOT_FOUND, NUMBER, REQUEST_PHRASES, ROUTING_STEMS, STOPWORDS

SQL: dict = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# scalar fragments


def low(c):
    return f"lower(translate({c}, 'Iİ', 'ıi'))"


def upp(c):
    return f"upper(translate({c}, 'iı', 'İI'))"


def plain(c):
    return f"translate({low(c)}, 'çğıöşü', 'cgiosu')"


def fold(c):
    return f"regexp_replace(translate({low(c)}, 'çğıîöşüâ', 'cgiiosua'), '\\s+', ' ', 'g')"


def norm(c):
    return f"trim(regexp_replace(regexp_replace({plain(c)}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


STOP = "[" + ", ".join(map(lit, STOPWORDS)) + "]"


def tok(c):
    return f"list_filter(string_split(regexp_replace({plain(c)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: len(t) >= 2 AND NOT list_contains({STOP}, t))"


def digits(c):
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def tckn(c):
    s = digits(c)
    d = lambda i: f"CAST(nullif(substr({s}, {i + 1}, 1), '') AS INT)"
    odd, even = " + ".join(d(i) for i in (0, 2, 4, 6, 8)), " + ".join(d(i) for i in (1, 3, 5, 7))
    return f"coalesce(regexp_full_match({s}, '[1-9][0-9]{{10}}') AND (({odd}) * 7 - ({even}) + 100) % 10 = {d(9)} AND ({odd} + {even} + {d(9)}) % 10 = {d(10)}, false)"


def vkn(c):
    s = digits(c)
    parts = []
    for i in range(9):
        t = f"((CAST(nullif(substr({s}, {i + 1}, 1), '') AS INT) + {9 - i}) % 10)"
        parts.append(f"(CASE WHEN {t} = 0 THEN 0 WHEN {t} * {2 ** (9 - i)} % 9 = 0 THEN 9 ELSE {t} * {2 ** (9 - i)} % 9 END)")
    return f"coalesce(regexp_full_match({s}, '[0-9]{{10}}') AND (10 - ({' + '.join(parts)}) % 10) % 10 = CAST(nullif(substr({s}, 10, 1), '') AS INT), false)"


def distinct(c):
    """Distinct values of a list in order of first sight."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def found_ids(c):
    runs = f"list_transform(regexp_extract_all({c}, '\\b[0-9][0-9\\s.]{{8,14}}[0-9]\\b'), lambda x: {digits('x')})"
    return distinct(f"list_filter({runs}, lambda x: len(x) = 11 AND {tckn('x')})"), distinct(f"list_filter({runs}, lambda x: len(x) = 10 AND {vkn('x')})")


def words(c, a, b):
    return f"array_to_string(string_split({c}, ' ')[{a}:{a + b - 1}], ' ')"


def article(c):
    return f"CASE WHEN regexp_extract({c}, '[0-9]+') <> '' THEN regexp_extract({c}, '[0-9]+') ELSE trim({c}) END"


def same_service(a, b):
    x, y = norm(a), norm(b)
    long = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: len(w) > 3))"
    fewer = f"least(len({long(x)}), len({long(y)}))"
    return f"coalesce({x} <> '' AND {y} <> '' AND ({x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) OR ({fewer} > 0 AND len(list_intersect({long(x)}, {long(y)})) >= {fewer} * 0.6)), false)"


def simple(c):
    return low(f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))")


REQUESTS = "[" + ", ".join(map(lit, REQUEST_PHRASES)) + "]"
PHRASES = "[" + ", ".join(map(lit, REQUEST_PHRASES.values())) + "]"

# adapters

DOCS = """docs AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, source || '/' || d.doc_id || '.txt' AS filename, text, lang AS doc_type, source,
  CASE WHEN source IN ('src0', 'src1') THEN 'regulations' ELSE 'documents' END AS corpus, toxic = 1 AS contains_pii, CAST(quality AS DOUBLE) AS confidence, d.doc_id AS n
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

FLOW = """flow AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, '/in/evrak-' || o_orderkey || '.pdf' AS path, 'evrak-' || o_orderkey || '.pdf' AS filename, 'pdf' AS format, o_orderkey * 10 AS size_bytes,
  sha256(CAST(o_orderkey AS VARCHAR)) AS hash, CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'parsed' END AS status, CASE WHEN o_orderkey % 10 = 0 THEN 'bozuk dosya' END AS error,
  CASE WHEN o_orderkey % 10 > 1 THEN o_orderkey || '.md' END AS parsed_path, o_orderdate AS created_at, o_orderdate AS updated_at, CASE WHEN o_orderkey % 50 = 0 THEN 'regulations' ELSE 'documents' END AS corpus,
  CASE WHEN o_orderkey % 23 = 0 THEN 's' || (o_orderkey % 7) END AS session_id,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'in_progress' WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 3 = 1 THEN 'routed' ELSE 'in_progress' END AS lifecycle_status,
  CASE o_orderkey % 11 WHEN 0 THEN 'pending' WHEN 1 THEN 'belirlenemedi' ELSE 'routed' END AS routing_status, CASE WHEN o_orderkey % 11 > 1 THEN o_orderpriority END AS routed_service,
  CASE WHEN o_orderkey % 11 > 1 THEN c_mktsegment END AS routed_unit, CASE WHEN o_orderkey % 11 > 1 THEN (o_orderkey % 100) / 100 END AS routing_confidence, CASE WHEN o_orderkey % 11 > 1 THEN 'auto' END AS routing_reasoning,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus || '|' || (o_custkey % 400) END AS routing_key, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS completed_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'onay' END AS completed_decision, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS classified_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS gaps_scanned_at, o_orderkey AS n, o_custkey
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

LETTERS = "letters AS (SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS document_id, l_returnflag AS decision, l_shipdate AS created_at, l_linestatus = 'F' AS saved FROM lineitem)"

CHUNKS = """chunks AS (SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS doc_id, CASE WHEN l_linenumber = 1 THEN 'parent' ELSE 'child' END AS kind, l_linenumber AS ordinal,
  '[' || l_returnflag || ']' || chr(10) || 'parca ' || l_partkey AS text, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS section, CAST(l_quantity AS INT) AS token_count, CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate END AS embedded_at FROM lineitem)"""

MSG = "msg AS (SELECT conv_id AS document_id, turn AS seq, role, text AS content FROM conversations)"

SERVICES = """svc AS (SELECT n_name || ' Servisi' AS service, CAST(n_regionkey + 10 AS VARCHAR) AS article_no, CASE WHEN n_regionkey % 2 = 0 THEN 'A) Ana Hizmet Birimleri' ELSE 'B) Diğer Hizmet Birimleri' END AS unit,
  CASE n_regionkey % 4 WHEN 0 THEN 'I- Vergilendirme Bölümü' WHEN 1 THEN 'II- Muhasebe Bölümü' WHEN 2 THEN 'III- Kovuşturma Bölümü' ELSE 'IV- Tarama ve Kontrol' END AS sub_unit,
  CAST(n_nationkey % 5 + 1 AS VARCHAR) AS service_no, n_nationkey % 7 <> 0 AS certain, n_nationkey AS nk FROM nation)"""

HITS = SERVICES + """, hits AS (SELECT CAST(o_orderkey AS VARCHAR) AS decision_id, CAST(i + 1 AS INT) AS rank, svc.* EXCLUDE nk FROM orders, unnest(range(0, 5)) AS u(i) JOIN svc ON svc.nk = (o_custkey + i * 3) % 25)"""

DECS = """decs AS (SELECT CAST(o_orderkey AS VARCHAR) AS decision_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Muhasebe' END AS main_unit, CASE WHEN o_orderkey % 5 = 1 THEN 'Takdir' END AS other_unit,
  CASE o_orderkey % 4 WHEN 1 THEN lower(service) WHEN 3 THEN NULL ELSE service END AS service,
  CASE WHEN o_orderkey % 6 = 0 THEN ['99'] ELSE [article_no || '-' || substr(unit, 1, 1) || '-' || split_part(sub_unit, '-', 1) || '-' || service_no, '99'] END AS cited,
  CASE WHEN o_orderkey % 6 = 0 THEN ['Yok'] ELSE [sub_unit, 'Yok'] END AS titles, (o_orderkey % 100) / 100 AS confidence, o_orderkey % 17 = 0 AS undetermined, CASE WHEN o_orderkey % 3 = 0 THEN 'gerekce' ELSE '' END AS reasoning,
  CASE WHEN o_orderkey % 2 = 0 THEN 'k' || (o_orderkey % 100) END AS routing_key, o_orderkey AS k
  FROM orders JOIN svc ON svc.nk = (o_custkey + CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 3 END) % 25)"""

IDS = """ids AS (SELECT o_orderkey AS n, right(lpad(CAST(o_orderkey * 104729 + o_custkey * 7 AS VARCHAR), 10, '0'), 10) AS tax, right(lpad(CAST(o_orderkey * 1299709 + o_custkey * 31 + 10000000000 AS VARCHAR), 11, '0'), 11) AS person FROM orders),
idt AS (SELECT *, 'Vergi no ' || tax || ', kimlik ' || person || ' ve 2026-01-15.' AS text FROM ids)"""

INCOMING = """inc AS (SELECT id, CASE WHEN n % 2 = 0 THEN path ELSE path || '.new' END AS path, filename, format, size_bytes + 1 AS size_bytes, CASE WHEN n % 4 = 0 THEN hash ELSE sha256(id || 'x') END AS hash FROM flow WHERE n % 3 = 0)"""

POSTS = f"""tk AS (SELECT id, {tok('text')} AS tokens FROM docs), tf AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, unnest(tokens) AS term, len(tokens) AS n FROM tk) GROUP BY id, term),
terms AS (SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, len(term) + 1), lambda i: CAST(ascii(substr(term, CAST(i AS INT), 1)) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS term_id FROM (SELECT DISTINCT term FROM tf)),
posts AS (SELECT id AS chunk_id, term_id, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 350.0)) AS weight FROM tf JOIN terms USING (term))"""

IDF = "idf AS (SELECT term_id, count(DISTINCT chunk_id) AS df, ln(((SELECT count(DISTINCT id) FROM docs) - count(DISTINCT chunk_id) + 0.5) / (count(DISTINCT chunk_id) + 0.5) + 1) AS idf FROM posts GROUP BY term_id)"

ASKED = f"""asked AS (SELECT 'q' || item_id AS id, {tok('text')} AS tokens, item_id FROM benchmark),
qtf AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, unnest(tokens) AS term, len(tokens) AS n FROM asked) GROUP BY id, term),
qw AS (SELECT id AS query_id, term_id, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 350.0)) AS q FROM qtf JOIN terms USING (term))"""

SCORED = "scored AS (SELECT query_id, chunk_id, round(sum(q * idf * weight), 6) AS score FROM qw JOIN idf USING (term_id) JOIN posts USING (term_id) GROUP BY 1, 2)"


def topk(source, k, score="score", keys="query_id"):
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, chunk_id) AS INT) AS rank FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, chunk_id) <= {k}"


SPARSE = f"WITH {DOCS}, {POSTS}, {IDF}, {ASKED}, {SCORED}, sparse AS ({topk('scored', 30)})"
DENSE = """vec AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
dscored AS (SELECT q.id AS query_id, c.id AS chunk_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM qvec q, vec c)"""
QVEC = "qvec AS (SELECT 'q' || item_id AS id, v FROM benchmark JOIN vec ON vec.id = CAST(item_id AS VARCHAR))"
VEC, DSCORED = DENSE.split(",\n")
BOTH = f"{SPARSE}, {VEC}, {QVEC}, {DSCORED}, dense AS ({topk('dscored', 30)})"
HITDOC = f"{SPARSE}, hd AS (SELECT s.query_id, s.chunk_id, s.score, s.rank, filename, text, source, doc_type, n, CAST(n % 3 AS INT) AS page FROM sparse s JOIN docs ON docs.id = s.chunk_id)"
REGULATED = HITDOC + ", rg AS (SELECT *, 'Madde ' || (n % 5 + 9) AS article_no, CASE WHEN n % 3 > 0 THEN 'S' || (n % 4) END AS service FROM hd)"

OFFICIAL = "corpus = 'documents' AND session_id IS NULL"


def docs_sql(select, more=""):
    return f"WITH {DOCS} SELECT id, {select} FROM docs {more}"


# sources
SQL["s1_scan_files"] = "SELECT doc_id, '.txt' AS format, strlen(text) + 1 AS size_bytes FROM documents WHERE text IS NOT NULL"
SQL["s3_read_text_documents"] = "SELECT doc_id, 'txt' AS kind, md5(text || chr(10)) AS text_md5 FROM documents WHERE text IS NOT NULL"
SQL["s11_read_golden"] = """SELECT 'g' || item_id AS id, CASE WHEN item_id % 5 = 0 THEN 'trap' ELSE 'fact' END AS scenario, md5(text) AS question, CASE WHEN item_id % 2 = 0 THEN item_id || '.txt' ELSE '' END AS expected_docs,
  CASE WHEN item_id % 3 = 0 THEN text ELSE '' END AS expected, CASE WHEN item_id % 7 = 0 THEN 'yasak' ELSE '' END AS forbidden FROM benchmark"""
SQL["s2_file_identity"] = "SELECT sha1(url) AS job_id, url AS path, split_part(url, '/', -1) AS filename, substr(lower(regexp_extract(url, '(\\.[^./]+)$', 1)), 2, 20) AS format, CAST(strlen(html) AS BIGINT) AS size_bytes, sha256(html) AS hash FROM pages"
SQL["s4_detect_changes"] = f"WITH {FLOW}, {INCOMING} SELECT inc.id, inc.path, CASE WHEN flow.id IS NULL THEN 'new' WHEN flow.hash IS NOT DISTINCT FROM inc.hash AND flow.status = 'parsed' THEN 'unchanged' ELSE 'changed' END AS change FROM inc LEFT JOIN flow ON flow.path = inc.path"
SQL["s5_upsert_documents"] = f"""WITH {FLOW}, {INCOMING} SELECT coalesce(f.id, i.id) AS id, coalesce(f.path, i.path) AS path, coalesce(f.filename, i.filename) AS filename, coalesce(f.format, i.format) AS format,
CASE WHEN i.id IS NOT NULL THEN i.size_bytes ELSE f.size_bytes END AS size_bytes, CASE WHEN i.id IS NOT NULL THEN i.hash ELSE f.hash END AS hash, CASE WHEN i.id IS NOT NULL THEN 'pending' ELSE f.status END AS status, CASE WHEN i.id IS NULL THEN f.error END AS error,
coalesce(f.created_at, TIMESTAMP '2030-01-01') AS created_at, CASE WHEN i.id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE f.updated_at END AS updated_at FROM flow f FULL JOIN inc i ON f.path = i.path"""
SQL["s6_apply_status"] = f"WITH {FLOW} SELECT id, CASE WHEN n % 4 = 0 THEN 'parsed' ELSE status END AS status, CASE WHEN n % 4 <> 0 THEN error END AS error, CASE WHEN n % 8 = 0 THEN id || '.v2.md' ELSE parsed_path END AS parsed_path FROM flow"
SQL["s7_replace_chunks"] = f"WITH {CHUNKS} SELECT id, doc_id, kind, ordinal FROM chunks WHERE CAST(doc_id AS BIGINT) % 5 <> 0 OR doc_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders) UNION ALL SELECT id || 'n', doc_id, kind, ordinal FROM chunks WHERE CAST(doc_id AS BIGINT) % 5 = 0 AND ordinal = 1"
SQL["s8_index_payload"] = f"WITH {DOCS} SELECT id, id AS doc_id, md5(text) AS text_md5, filename, doc_type, CASE WHEN n % 2 = 0 THEN source ELSE '' END AS entities, contains_pii, '' AS article_no, '' AS article_title, CAST(len(embedding) AS BIGINT) AS dims FROM docs JOIN embeddings ON vec_id = n"
NORMAL = "trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))"
SQL["s9_page_entries"] = f"WITH {DOCS}, t AS (SELECT id AS doc_id, string_split(text, chr(10)) AS l FROM docs), u AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, l[i] AS x FROM t, unnest(range(1, len(l) + 1)) AS v(i)) SELECT doc_id, pos, md5({NORMAL}) AS text_md5, CAST(pos // 2 + 1 AS INT) AS page FROM u WHERE pos <> 3"
SQL["s10_parse_model_output"] = """WITH r AS (SELECT user_id AS id, event_id AS attempt, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, event_id % 3 > 0 AND event_id % 5 > 0 AS well FROM events),
g AS (SELECT *, well AND k IS NOT NULL AND kind IN ('view', 'click', 'purchase') AND k BETWEEN 10 AND 60 AS good FROM r)
SELECT id, bool_or(good) AS ok, min(attempt) FILTER (WHERE good) AS attempt, arg_min(k, attempt) FILTER (WHERE good) AS k, arg_min(kind, attempt) FILTER (WHERE good) AS kind FROM g GROUP BY id"""
SQL["s12_tag_documents"] = f"WITH {FLOW} SELECT id, CASE WHEN n % 18 = 0 THEN 'regulations' ELSE corpus END AS corpus, CASE WHEN n % 27 = 0 THEN 's99' ELSE session_id END AS session_id FROM flow"

# chunking
SQL["c1_clean_markdown"] = docs_sql("md5(regexp_replace(regexp_replace('<!-- image -->' || repeat(chr(10), 4) || replace(text, chr(10), repeat(chr(10), 4)), '<!--\\s*image\\s*-->', '', 'g'), '\\n{3,}', repeat(chr(10), 2), 'g')) AS cleaned")
SQL["c2_estimate_tokens"] = docs_sql("CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens")
NL = "chr(10)"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
TOKENS = "CAST(ceil(length({}) / 3.5) AS INT)"
# the Markdown of a document, its lines, and blocks: runs of lines of one class; the texts hold no fences
BLOCKS = f"""{DOCS}, md AS (SELECT id, filename, '# ' || source || {NL} || {NL} || '## ' || doc_type || {NL} || {NL} || text || {NL} || {NL} || '| id | n |' || {NL} || '|---|---|' || {NL} || '| ' || id || ' | 1 |' || {NL} AS t FROM docs),
li AS (SELECT id, i, l[i] AS x FROM (SELECT id, string_split(regexp_replace(t, '\\n{{3,}}', {NL} || {NL}, 'g'), {NL}) AS l FROM md), unnest(range(1, len(l) + 1)) AS v(i)),
cl AS (SELECT *, CASE WHEN regexp_full_match(x, '#{{1,6}}\\s+.*') THEN 'heading' WHEN trim(x) = '' THEN 'blank' WHEN regexp_matches(x, '^\\s*\\|') THEN 'table' ELSE 'text' END AS c FROM li),
st AS (SELECT *, sum(CASE WHEN c = 'heading' OR c IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS b FROM (SELECT *, lag(c) OVER (PARTITION BY id ORDER BY i) AS before FROM cl)),
bl AS (SELECT id, b, any_value(c) AS c, arg_min(x, i) AS head, {STRIP.format(f"string_agg(x, {NL} ORDER BY i)")} AS whole FROM st WHERE c <> 'blank' GROUP BY id, b),
bk AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS INT) AS pos, CASE WHEN c = 'text' THEN CASE WHEN regexp_matches(head, '^\\s*([-*+]|[0-9]+[.])\\s+') THEN 'list' ELSE 'paragraph' END ELSE c END AS type,
  CASE WHEN c = 'heading' THEN trim(regexp_replace(head, '^#+\\s+', '')) ELSE whole END AS text, CASE WHEN c = 'heading' THEN CAST(length(regexp_extract(head, '^#+')) AS INT) END AS level FROM bl),
ends AS (SELECT h.id, h.pos, h.text, min(g.pos) AS until FROM bk h LEFT JOIN bk g ON g.id = h.id AND g.pos > h.pos AND g.level <= h.level WHERE h.level IS NOT NULL GROUP BY ALL),
above AS (SELECT bk.id, bk.pos, list(e.text ORDER BY e.pos) AS path FROM bk JOIN ends e ON e.id = bk.id AND e.pos <= bk.pos AND (until IS NULL OR until > bk.pos) GROUP BY ALL),
blocks AS (SELECT bk.*, coalesce(path, []) AS path FROM bk LEFT JOIN above USING (id, pos)),
ch AS (SELECT *, path[1:2] AS top, lag(path[1:2]) OVER (PARTITION BY id ORDER BY pos) AS before FROM blocks WHERE type <> 'heading'),
sections AS (SELECT *, sum(CASE WHEN top IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) - 1 AS section_no FROM ch),
whole AS (SELECT id, section_no, arg_min(top, pos) AS top, string_agg(text, {NL} || {NL} ORDER BY pos) AS w FROM sections GROUP BY ALL),
parents AS (SELECT id, CAST(section_no AS BIGINT) AS section_no, nullif(array_to_string(top, ' > '), '') AS section, '[Dosya: ' || filename || coalesce(' > ' || section, '') || ']' || {NL} AS crumb, CASE WHEN {TOKENS.format('w')} > 3500 THEN substr(w, 1, 14000) ELSE w END AS body FROM whole JOIN docs USING (id))"""
SQL["c3_parse_blocks"] = f"WITH {BLOCKS} SELECT id AS doc_id, pos, type, md5(text) AS text_md5, level, array_to_string(path, '|') AS path FROM blocks"
SQL["c4_assign_sections"] = f"WITH {BLOCKS} SELECT id AS doc_id, pos, CAST(section_no AS BIGINT) AS section_no, array_to_string(top, '|') AS path, md5(text) AS text_md5 FROM sections"
SQL["c5_parent_chunks"] = f"WITH {BLOCKS} SELECT id AS doc_id, section_no, section, md5(crumb || body) AS text_md5, {TOKENS.format('body')} AS token_count FROM parents"
# sentences, the running count of their tokens, and runs of sentences (first, last): each of 650 tokens with its first new sentence
# at least, beginning with the last sentences of the run before that make 78 tokens
PIECES = f"""sent AS (SELECT id, s, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: ceil(length(x) / 3.5)))) AS p FROM (SELECT id, regexp_extract_all(text, '[^.!?\\n]+[.!?\\n]+|\\s*[^.!?\\n]+$') AS s FROM docs)),
runs AS (SELECT id, 0 AS r, 1 AS a, CAST(greatest(1, len(list_filter(p, lambda v: v <= 650))) AS INT) AS z FROM sent WHERE len(s) > 0
  UNION ALL SELECT id, r, a, CAST(greatest(k, len(list_filter(p, lambda v: v <= 650 + CASE WHEN a > 1 THEN p[a - 1] ELSE 0 END))) AS INT) FROM (SELECT id, r + 1 AS r, z + 1 AS k, CAST(greatest(a, 1 + len(list_filter(p, lambda v: v <= p[z] - 78))) AS INT) AS a, p FROM runs JOIN sent USING (id) WHERE z < len(p))),
cut AS (SELECT id, r, {STRIP.format("array_to_string(s[a:z], '')")} AS piece FROM runs JOIN sent USING (id)),
pieces AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY r) - 1 AS INT) AS pos, piece FROM cut WHERE piece <> '')"""
SQL["c7_split_long_text"] = f"WITH RECURSIVE {DOCS}, {PIECES} SELECT id, pos, md5(piece) AS piece_md5 FROM pieces"
# a document is one section of a paragraph (whole, or in pieces beyond 900 tokens) and a table, which joins the paragraph up to 900 tokens
CHILDREN = f"""{BLOCKS}, {PIECES}, two AS (SELECT id, coalesce(max(text) FILTER (WHERE type = 'paragraph'), '') AS t, max(text) FILTER (WHERE type = 'table') AS tab FROM sections GROUP BY id),
kids AS (SELECT id, pos, piece AS body FROM pieces JOIN two USING (id) WHERE {TOKENS.format('t')} > 900
  UNION ALL SELECT id, 0, t || {NL} || {NL} || tab FROM two WHERE t <> '' AND {TOKENS.format('t')} + {TOKENS.format('tab')} <= 900
  UNION ALL SELECT id, 0, t FROM two WHERE {TOKENS.format('t')} BETWEEN 1 AND 900 AND {TOKENS.format('t')} + {TOKENS.format('tab')} > 900
  UNION ALL SELECT id, 1 << 20, tab FROM two WHERE t = '' OR {TOKENS.format('t')} + {TOKENS.format('tab')} > 900),
children AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INT) AS ordinal, body FROM kids)"""
SQL["c6_child_chunks"] = f"WITH RECURSIVE {CHILDREN} SELECT id AS doc_id, ordinal, md5(body) AS body_md5, {TOKENS.format('body')} AS body_tokens FROM children"
SQL["c9_chunk_documents"] = f"""WITH RECURSIVE {CHILDREN} SELECT sha256(id || ':parent:' || section_no) AS id, id AS doc_id, 'parent' AS kind, CAST(section_no AS INT) AS ordinal, md5(crumb || body) AS text_md5, section, NULL AS parent_id, {TOKENS.format('body')} AS token_count FROM parents
UNION ALL SELECT sha256(c.id || ':child:' || ordinal), c.id, 'child', ordinal, md5(crumb || c.body), section, sha256(c.id || ':parent:0'), {TOKENS.format('(crumb || c.body)')} FROM children c JOIN parents p USING (id)"""
# a regulation's articles and the segments of its third; a text stands in the first article and in the first service
LAST = f"'A) Ana Hizmet Birimleri' || {NL} || {NL} || 'I- Vergilendirme Bölümü' || {NL} || {NL} || '1) Sicil Servisi' || {NL} || {NL} || x || {NL} || {NL} || '2) Tecil Servisi' || {NL} || {NL} || '- takip' || {NL}"
ARTICLES = f"""{DOCS}, rg AS (SELECT id, filename, regexp_replace(text, '[ \\t]+(\\n|$)', '\\1', 'g') AS x FROM docs WHERE corpus = 'regulations'),
ar AS (SELECT id, filename, x, CAST(p AS INT) AS pos, ['Amaç', 'Kapsam ve Dayanak Esasları', 'Görev Dağılımı'][p + 1] AS title, {NL} || [x || {NL}, 'ara metin' || {NL}, {LAST}][p + 1] AS body FROM rg, unnest(range(0, 3)) AS u(p))"""
SQL["c10_parse_articles"] = f"WITH {ARTICLES} SELECT id AS doc_id, pos, title, 'BİRİNCİ KISIM Genel' AS part, CASE pos WHEN 0 THEN 1 WHEN 2 THEN 3 END AS number, md5(body) AS body_md5 FROM ar"
SQL["c11_infer_article_numbers"] = f"WITH {ARTICLES} SELECT id AS doc_id, CAST(pos + 1 AS VARCHAR) AS article_no, title, pos <> 1 AS certain, md5(body) AS body_md5 FROM ar"
SEGMENTS = f"""{ARTICLES}, sg AS (SELECT id, filename, title, pos, 0 AS segment, NULL AS unit, NULL AS sub_unit, NULL AS service, [] AS markers, body FROM ar WHERE pos < 2
  UNION ALL SELECT id, filename, title, pos, CAST(k AS INT), 'A) Ana Hizmet Birimleri', 'I- Vergilendirme Bölümü', ['Sicil Servisi', 'Tecil Servisi'][k + 1], ['A) Ana Hizmet Birimleri', 'I- Vergilendirme Bölümü', ['Sicil Servisi', 'Tecil Servisi'][k + 1]], {NL} || [x, '- takip'][k + 1] || {NL} FROM ar, unnest([0, 1]) AS u(k) WHERE pos = 2)"""
SQL["c12_split_segments"] = f"WITH {SEGMENTS} SELECT id AS doc_id, pos, segment, unit, sub_unit, service, CAST(NULL AS VARCHAR) AS service_no, array_to_string(markers, '|') AS markers, md5(body) AS body_md5 FROM sg"
INFERRED = f"{NL} || '(Not: bu maddenin numarasi kaynak metinden okunamadi, komsu madde numaralarindan turetildi.)'"
SQL["c13_chunk_regulations"] = f"""WITH {SEGMENTS}, pa AS (SELECT id, filename, title, pos, segment, unit, service, markers, body, 'child' AS kind, pos + segment AS ordinal FROM sg UNION ALL SELECT id, filename, title, pos, 0, NULL, NULL, [], body, 'parent', 0 FROM ar WHERE pos = 2),
tx AS (SELECT *, 'Madde ' || (pos + 1) || ' - ' || title AS label, '[Dosya: ' || filename || ' > ' || array_to_string(list_concat(['BİRİNCİ KISIM Genel', label], markers), ' > ') || ']' || {NL} || array_to_string(list_prepend(label, markers), {NL}) || CASE WHEN pos = 1 THEN {INFERRED} ELSE '' END || {NL} || {NL} || {STRIP.format('body')} AS text FROM pa)
SELECT sha256(id || ':' || kind || ':' || ordinal) AS id, id AS doc_id, kind, CAST(ordinal AS INT) AS ordinal, md5(text) AS text_md5, label || coalesce(' > ' || service, '') AS section, CASE WHEN service IS NOT NULL THEN sha256(id || ':parent:0') END AS parent_id, {TOKENS.format('text')} AS token_count, CAST(pos + 1 AS VARCHAR) AS article_no, unit, service, pos <> 1 AS certain FROM tx"""
SQL["c8_assign_pages"] = f"""WITH {DOCS}, t AS (SELECT id || '-' || k AS id, substr(trim(regexp_replace(lower(substr(text, 400 * k + 1, 400)), '\\s+', ' ', 'g')), 1, 80) AS probe, string_split(text, chr(10)) AS l FROM docs, unnest(range(0, length(text) // 400 + 1)) AS w(k)),
u AS (SELECT id, i, probe, trim(regexp_replace(lower(l[i]), '\\s+', ' ', 'g')) AS e FROM t, unnest(range(1, len(l) + 1)) AS v(i) WHERE length(probe) >= 15),
p AS (SELECT id, coalesce(min(i) FILTER (WHERE contains(e, probe) OR contains(probe, e)), min(i) FILTER (WHERE contains(e, substr(probe, 1, 40)))) AS page FROM u GROUP BY id)
SELECT t.id, CAST(page AS INT) AS page FROM t LEFT JOIN p USING (id)"""
SQL["c14_pending_chunking"] = f"WITH {FLOW}, {CHUNKS} SELECT id FROM flow WHERE status = 'parsed' AND id NOT IN (SELECT doc_id FROM chunks WHERE CAST(doc_id AS BIGINT) % 2 = 0)"
SQL["c15_regulation_candidates"] = f"WITH {DOCS} SELECT id, 'VERGİ YÖNETMELİĞİ ' || filename AS filename FROM docs WHERE n % 4 = 0"
SQL["c16_chunk_stats"] = f"WITH {CHUNKS} SELECT count(DISTINCT doc_id) AS docs, count(*) FILTER (WHERE kind = 'child') AS children, count(*) FILTER (WHERE kind = 'parent') AS parents, CAST(coalesce(round(avg(token_count) FILTER (WHERE kind = 'child')), 0) AS BIGINT) AS avg_child_tokens FROM chunks"

# text
SQL["t1_tr_lower"] = docs_sql(f"md5({low(chr(40) + 'text || ' + lit('Iİ') + chr(41))}) AS value")
SQL["t2_tr_fold"] = docs_sql(f"md5({fold('text')}) AS value")
SQL["t3_tr_normalize"] = docs_sql(f"md5({norm('text')}) AS value")
SQL["t4_tokenize"] = docs_sql(f"md5(array_to_string({tok('text')}, '|')) AS value, CAST(len({tok('text')}) AS BIGINT) AS n")
SQL["t5_only_digits"] = docs_sql(f"{digits('text')} AS value")
SQL["t6_is_valid_tckn"] = f"WITH {IDS} SELECT n, {tckn('person')} AS value FROM idt"
SQL["t7_is_valid_vkn"] = f"WITH {IDS} SELECT n, {vkn('tax')} AS value FROM idt"
T_, V_ = found_ids("text")
SQL["t8_extract_identifiers"] = f"WITH {IDS}, f AS (SELECT n, {T_} AS t, {V_} AS v FROM idt) SELECT n, array_to_string(t, '|') AS tckn, array_to_string(v, '|') AS vkn FROM f"
SQL["t9_validate"] = f"WITH {IDS} SELECT n, CASE WHEN {tckn('person')} THEN person END AS tckn, CASE WHEN n % 2 = 0 THEN CASE WHEN {tckn('person')} THEN person END ELSE CASE WHEN {vkn('tax')} THEN tax END END AS vkn FROM idt"
SQL["t10_reconcile_identifiers"] = f"""WITH {IDS}, f AS (SELECT *, {T_} AS t, {V_} AS v FROM idt)
SELECT n, coalesce(CASE WHEN n % 3 = 0 AND {vkn('tax')} THEN tax END, CASE WHEN len(v) = 1 THEN v[1] END, CASE WHEN len(t) = 1 THEN t[1] END) AS vkn, CASE WHEN len(t) = 1 THEN t[1] END AS tckn, 'A|' || tax AS people FROM f"""
PHRASE = f"CASE n % 4 WHEN 0 THEN {words('text', 2, 3)} WHEN 1 THEN {words('text', 2, 2)} || ' zzzz ' || {words('text', 5, 3)} WHEN 2 THEN 'uydurma (' || {words('text', 3, 1)} || ')' ELSE 'olmayan deyim' END"
SQL["t11_ground_phrase"] = f"""WITH {DOCS}, p AS (SELECT id, regexp_replace(trim({PHRASE}), '\\s+', ' ', 'g') AS whole, {fold('text')} AS src FROM docs),
q AS (SELECT *, trim(regexp_extract(whole, '\\(([^)]{{2,12}})\\)', 1)) AS short, list_filter(regexp_split_to_array(regexp_replace(whole, '[()]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM p),
r AS (SELECT id, arg_min(run, (-k) * 1000 + i) AS run FROM (SELECT id, src, k, i, array_to_string(w[i:i + k - 1], ' ') AS run FROM q, unnest(range(2, len(w) + 1)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)) WHERE contains(src, {fold('run')}) GROUP BY id)
SELECT q.id, CASE WHEN coalesce(whole, '') = '' THEN '' WHEN contains(src, {fold('whole')}) THEN whole WHEN short <> '' AND contains(src, {fold('short')}) THEN short ELSE coalesce(run, '') END AS value FROM q LEFT JOIN r USING (id)"""
SQL["t12_verify_findings"] = f"""WITH {DOCS}, f AS (SELECT id, text, n, unnest([0, 1, 2]) AS pos FROM docs),
g AS (SELECT *, [2, 0, 1][pos + 1] AS rank, CASE pos WHEN 0 THEN {words('text', 2, 3)} WHEN 1 THEN {words('text', 1, 2)} || ' … ' || {words('text', 4, 2)} ELSE CASE WHEN n % 2 = 0 THEN '' ELSE 'yok boyle' END END AS quote, {simple('substr(text, 1, 12000)')} AS body FROM f),
h AS (SELECT *, list_filter(list_transform(regexp_split_to_array(quote, '…|\\.\\.\\.'), lambda p: {simple('p')}), lambda p: p <> '') AS parts FROM g)
SELECT id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY rank, pos) AS kept FROM h WHERE quote = '' OR (len(parts) > 0 AND len(list_filter(parts, lambda p: NOT contains(body, p))) = 0) GROUP BY id"""
SQL["t13_routing_key"] = docs_sql(f"doc_type || '|' || corpus || '|' || trim(regexp_replace({low('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS value")
REC = f"CASE WHEN n % 2 = 0 THEN {words('text', 1, 2)} ELSE '' END"
SQL["t14_routing_query"] = f"WITH {DOCS}, r AS (SELECT *, {REC} AS rec, {PHRASES}[n % 9 + 1] AS ph FROM docs) SELECT id, ph || CASE WHEN rec <> '' THEN ' ' || rec ELSE '' END AS query, 'Belge turu: ' || doc_type || chr(10) || 'Talep edilen islem: ' || ph || chr(10) || CASE WHEN rec <> '' THEN 'Alacak/vergi turu: ' || rec || chr(10) ELSE '' END || 'Ozet: ' || {words('text', 1, 3)} AS text FROM r"
SQL["t15_parse_citation"] = f"""WITH {SERVICES}, {DECS}, p AS (SELECT decision_id, cited[1] AS a, list_filter(regexp_split_to_array(cited[1], '[-.\\s]+'), lambda x: x <> '') AS parts FROM decs), q AS (SELECT *, CASE WHEN regexp_full_match(parts[1], '[0-9]+') THEN parts[2:] ELSE parts END AS rest FROM p)
SELECT decision_id, {article('a')} AS article, list_filter(rest, lambda x: regexp_full_match(x, '[A-C]'))[1] AS unit, list_filter(rest, lambda x: x IN ('I', 'II', 'III', 'IV', 'V'))[1] AS part, list_filter(rest, lambda x: regexp_full_match(x, '[0-9]+'))[1] AS service FROM q"""
SQL["t16_same_service"] = f"""WITH {SERVICES}, o AS (SELECT lower(substr(service, 1, 8)) || ' servis' AS other FROM svc), m AS (SELECT service, other FROM svc, o WHERE {same_service('service', 'other')}),
c AS (SELECT 'NATION_' || c_nationkey || ' Servisi' AS service FROM customer) SELECT service, other, count(*) AS n, bool_or({norm('service')} = {norm('other')}) AS strict FROM m JOIN c USING (service) GROUP BY ALL"""
SQL["t16_best_service"] = f"""WITH {SERVICES}, a AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'nation_' || o_orderkey % 25 || ' servısı' WHEN 1 THEN 'Nation ' || o_orderkey % 25 WHEN 2 THEN 'NATION_' || o_orderkey % 25 || ' Servisi Şefliği' ELSE 'Gelir ' || o_orderkey % 25 END AS name FROM orders),
g AS (SELECT name, count(*) AS n FROM a GROUP BY 1), m AS (SELECT name, n, service, {norm('service')} <> {norm('name')} AS loose FROM g, svc WHERE {same_service('service', 'name')})
SELECT name, any_value(n) AS n, arg_min(service, {{'l': loose, 's': service}}) AS service FROM m GROUP BY name"""
SQL["t17_service_predicates"] = f"""WITH {FLOW}, s AS (SELECT id, routed_service || CASE n % 3 WHEN 0 THEN ' Arşiv Servisi' WHEN 1 THEN ' İhtilaflı  İşler' ELSE '' END AS s, n FROM flow)
SELECT id, coalesce(contains({norm('s')}, 'arsiv'), false) AS entry_point, coalesce(contains({norm('s')}, 'ihtilafli isler'), false) AS dispute, n % 14 = 12 AS dependent FROM s"""
SQL["t18_is_not_found"] = docs_sql(f"regexp_matches({plain(chr(40) + 'text || CASE WHEN n % 3 = 0 THEN ' + lit(' Bu BİLGİ dokümanlarda BULUNAMADI.') + ' ELSE ' + lit('') + ' END' + chr(41))}, {lit('|'.join(NOT_FOUND))}) AS value")
_REPLY = "('Tutar ' || (n * 37) || ',00 TL, 2,5 ve ' || text)"
_SUPPORTED = "d = k OR (len(d) >= 3 AND starts_with(k, d)) OR (len(k) >= 3 AND starts_with(d, k))"
SQL["t19_unsupported_numbers"] = f"""WITH {DOCS}, r AS (SELECT id, regexp_extract_all({_REPLY}, {lit(NUMBER)}) AS nums, text || ' ' || (n * 37) AS src FROM docs),
k AS (SELECT id, nums, regexp_replace(src, '\\s+', ' ', 'g') AS flat, list_transform(regexp_extract_all(src, {lit(NUMBER)}), lambda x: {digits('x')}) AS known FROM r),
u AS (SELECT id, flat, known, nums[i] AS x, {digits('nums[i]')} AS d, i FROM k, unnest(range(1, len(nums) + 1)) AS v(i)),
b AS (SELECT id, x, min(i) AS i FROM u WHERE len(d) >= 2 AND NOT contains(flat, x) AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(known) AS k) WHERE {_SUPPORTED}) GROUP BY id, x)
SELECT docs.id, coalesce(string_agg(x, '|' ORDER BY i), '') AS value FROM docs LEFT JOIN b USING (id) GROUP BY docs.id"""
SQL["t20_normalize_body"] = docs_sql("md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(replace(x, '**', ''), '\\s+', ' ', 'g'))), lambda x: x <> ''), '|')) AS value")
SQL["t21_snippet"] = docs_sql("substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS value")
SQL["t22_finalize_classification"] = f"WITH {DOCS}, e AS (SELECT *, string_split(text, ' ') AS w, least(1.0, n % 15 / 10.0) AS c FROM docs) SELECT id, CAST(c AS DOUBLE) AS confidence, array_to_string(({distinct('w')})[1:10], '|') AS entities, c < 0.6 AS needs_review, substr(text, 1, 500) AS summary FROM e"
SQL["t23_analysis_from_row"] = f"""WITH {DOCS}, r AS (SELECT *, CASE WHEN n % 2 = 0 THEN {words('text', 1, 2)} END AS s, CASE WHEN n % 3 = 0 THEN {words('text', 2, 2)} END AS t FROM docs)
SELECT id, coalesce(s, filename) AS subject, coalesce(t, s, filename) AS title, CASE WHEN n % 4 = 0 THEN {words('text', 1, 9)} ELSE '' END AS summary, CASE WHEN n % 5 > 0 THEN doc_type ELSE 'diger' END AS doc_type,
CASE WHEN n % 3 = 1 THEN 'diger' ELSE {REQUESTS}[n % 9 + 1] END AS request, '' AS receivable, CASE WHEN n % 2 = 0 THEN source ELSE '' END AS people, coalesce(contains_pii, false) AS contains_pii, coalesce(confidence, 0.0) AS confidence FROM r"""
SQL["t24_tag_messages"] = f"""WITH {MSG}, m AS (SELECT document_id, seq, content || CASE document_id % 3 WHEN 0 THEN ' Yazıyı ONAYLA' WHEN 1 THEN ' hangi SERVİS?' ELSE '' END AS content FROM msg)
SELECT document_id, seq, regexp_matches({norm('content')}, {lit('|'.join(LETTER_STEMS))}) AS may_ask_letter, regexp_matches({norm('content')}, {lit('|'.join(ROUTING_STEMS))}) AS asks_routing FROM m"""
LETTER_ROWS = f"""{DOCS}, li AS (SELECT id AS document_id, n, CASE WHEN n % 3 = 0 THEN '' ELSE {words('text', 1, 25)} END AS title, {words('text', 3, 4)} AS subj FROM docs),
lk AS (SELECT *, regexp_replace(regexp_replace(CASE WHEN trim(title) = '' THEN trim(subj) ELSE trim(title) END, '\\s+', ' ', 'g'), '[.]+$', '') AS s, n % 2 = 0 AS court,
  CASE WHEN n % 2 = 0 THEN CASE WHEN n % 7 = 0 THEN 'Form Adı Başkanlığı' WHEN n % 4 = 0 THEN 'İzmir Vergi Mahkemesine Başkanlığı' ELSE '[VERGİ MAHKEMESİ BAŞKANLIĞI]' END
       ELSE CASE WHEN n % 7 = 0 THEN 'Form Adı' ELSE '[MUHATAP]' END END AS recipient FROM li),
lm AS (SELECT *, CASE WHEN court OR n % 11 = 0 THEN 'kurum' ELSE 'kisi' END AS kind FROM lk)"""
LETTER_ROWS = LETTER_ROWS.replace("İzmir Vergi Mahkemesine Başkanlığı", "İzmir Vergi Mahkemesi Başkanlığı")
CLOSING = "CASE WHEN court THEN 'Bilgi ve gereğini arz ederim.' WHEN n % 3 = 0 THEN 'Eksik belge ve bilgilerin tamamlanması hususunda gereğini rica ederim.' WHEN kind = 'kurum' THEN 'Bilgilerini ve gereğini rica ederim.' ELSE 'Bilgi edinilmesini rica ederim.' END"
SQL["t25_build_letters"] = f"""WITH {LETTER_ROWS} SELECT document_id, 'E-12345678-045.01-' || CASE WHEN n % 2 = 0 THEN CAST(n AS VARCHAR) ELSE '[SIRA NO]' END AS number, strftime(DATE '2026-01-05' + CAST(n % 300 AS INT), '%d.%m.%Y') AS date,
CASE WHEN length(s) > 90 THEN rtrim(substr(s, 1, 87)) || '...' ELSE s END AS subject, recipient, kind AS recipient_kind, CASE WHEN NOT court THEN CASE WHEN n % 5 = 0 THEN '4840847211' ELSE '10000000146' END END AS recipient_number,
CASE WHEN kind = 'kurum' THEN {upp('recipient')} ELSE 'Sayın ' || recipient END AS address_line, {CLOSING} AS closing,
'Birim adı (LETTER_BIRIM_ADI)|İmza sahibi (LETTER_IMZA_AD)|İmza unvanı (LETTER_IMZA_UNVAN)' || CASE WHEN recipient = '[MUHATAP]' THEN '|Muhatap adı (form)' WHEN recipient LIKE '[VERG%' THEN '|Vergi mahkemesi adı (evrakta bulunamadı)' ELSE '' END AS missing FROM lm"""
SQL["m5_draft_letters"] = f"""WITH {LETTER_ROWS} SELECT document_id, recipient, kind AS recipient_kind, CASE WHEN NOT court THEN CASE WHEN n % 5 = 0 THEN '4840847211' ELSE '10000000146' END END AS recipient_number, CASE WHEN kind = 'kurum' THEN {upp('recipient')} ELSE 'Sayın ' || recipient END AS address_line, {CLOSING} AS closing FROM lm"""
SQL["t26_letter_blocks"] = f"""WITH {DOCS}, w AS (SELECT id, n, string_split(text, ' ') AS w, replace({words('text', 1, 2)}, 'ß', 'ss') AS a FROM docs), v AS (SELECT *, w[1:3] AS r, w[1:n % 3] AS e FROM w)
SELECT id, CASE WHEN n % 2 = 0 THEN {upp('a')} ELSE 'Sayın ' || a END AS address, array_to_string(list_transform(r, lambda x, i: CASE WHEN regexp_matches(trim(x), '^[A-Za-zçğıöşüÇĞİÖŞÜ]\\s*\\)') THEN trim(x) ELSE chr(CAST(96 + i AS INT)) || ') ' || trim(x) END), '|') AS refs,
CASE WHEN len(e) = 0 THEN '' ELSE (CASE WHEN len(e) > 1 THEN 'Ekler:' ELSE 'Ek:' END) || '|' || array_to_string(list_transform(e, lambda x, i: i || '- ' || x), '|') END AS attachments, 'Telefon: 0312' AS contact FROM v"""
SQL["t27_document_record"] = f"""WITH {DOCS}, r AS (SELECT *, trim({words('text', 1, 3)}) AS s, trim(regexp_replace({words('text', 2, 2)}, '\\s+', ' ', 'g')) AS q, {words('text', 2, 2)} AS q0, {words('text', 1, 2)} AS x FROM docs)
SELECT id, concat_ws(chr(10), '- Dosya: ' || filename, '- Evrak tipi: ' || doc_type, CASE WHEN s <> '' THEN '- Konu: ' || s END, '- TCKN: 1', '- Kisi/Kurum: ' || source || ' · ' || doc_type, '- Is akisi durumu: ' || ['yeni geldi', 'tamamlandi', 'baska'][n % 3 + 1],
CASE n % 3 WHEN 0 THEN '- Eksik bilgi taramasinin bulgulari:' || chr(10) || '  · [kritik] ' || CASE WHEN n % 2 = 0 THEN 'Eksik' ELSE 'Tutarsizlik' END || ': Tarih — ' || x || CASE WHEN q0 <> '' THEN ' (belgeden: "' || q || '")' ELSE '' END
 WHEN 1 THEN '- Eksik bilgi taramasi yapildi, eksik ya da celiskili bilgi bulunmadi.' END,
CASE WHEN n % 2 = 0 THEN '- Yonlendirilen servis: Tecil Servisi' || CASE WHEN n % 4 = 0 THEN ' (Birim)' ELSE '' END ELSE '- Yonlendirme: servis belirlenemedi, evrak manuel inceleme bekliyor' END, CASE WHEN n % 2 = 0 THEN '- Yonlendirme guven skoru: 0.5' END, '- Yonlendirme gerekcesi: neden') AS record FROM r"""
SQL["t28_format_decision"] = f"""WITH {HITS}, {DECS}, inf AS (SELECT decision_id, list(DISTINCT article_no) AS a FROM hits WHERE NOT certain GROUP BY 1), r AS (SELECT decs.*, coalesce(a, []) AS a FROM decs LEFT JOIN inf USING (decision_id))
SELECT decision_id, CASE WHEN undetermined THEN 'belirlenemedi — manuel inceleme gerekli' || chr(10) || chr(10) || 'Gerekce: ' || reasoning ELSE
'Yonlendirme: ' || CASE WHEN main_unit IS NOT NULL THEN 'Ana Hizmet Birimi > ' || main_unit WHEN other_unit IS NOT NULL THEN 'Diger Hizmet Birimi > ' || other_unit ELSE 'Birim belirlenemedi' END || coalesce(' > ' || service, '') || chr(10)
|| 'Alt servis/masa: belirtilmedi (yonetmelik yalnizca servis seviyesinde dayanak sagliyor; masalar arasi gorev dagilimi Islem Yonergesi''nde)' || chr(10) || 'Guven skoru: ' || printf('%.2f', confidence) || chr(10)
|| 'Gerekce: ' || CASE WHEN reasoning <> '' THEN reasoning ELSE 'Karar, ' || array_to_string(list_transform(cited, lambda c: 'Madde ' || c), ', ') || ' kapsamindaki gorev tanimina dayanmaktadir.' END || chr(10) || chr(10) || 'Dayanak maddeler:' || chr(10)
|| array_to_string(list_transform(cited, lambda c, i: '[' || i || '] Madde ' || c || ' - ' || titles[i] || CASE WHEN list_contains(a, regexp_extract(c, '[0-9]+')) THEN ' (madde numarasi kaynak metinden okunamadi, sira ile turetildi)' ELSE '' END), chr(10)) END AS text FROM r"""
SQL["t29_escape_html"] = docs_sql("regexp_replace(replace(replace(replace(replace('<a href=\"x\">&[SIRA NO]' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\[([^\\]]+)\\]', '<span class=\"eksik\">[\\1]</span>', 'g') AS value")

# retrieval
SQL["r1_term_id"] = f"WITH {DOCS}, {POSTS} SELECT term, term_id FROM terms"
SQL["r2_sparse_postings"] = f"WITH {DOCS}, {POSTS} SELECT chunk_id, term_id, round(weight, 6) AS weight FROM posts"
SQL["s6_stored_registry"] = f"""WITH {FLOW}, d AS (SELECT id, CASE WHEN n % 4 = 0 THEN 'parsed' ELSE status END AS status, CASE WHEN n % 4 > 0 THEN error END AS error, CASE WHEN n % 8 = 0 THEN id || '.v2.md' ELSE parsed_path END AS parsed_path,
  CASE WHEN n % 18 = 0 THEN 'regulations' ELSE corpus END AS corpus, CASE WHEN n % 27 = 0 THEN 's99' ELSE session_id END AS session_id FROM flow),
c AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, l_linenumber AS o FROM lineitem WHERE l_orderkey % 5 > 0 OR l_linenumber <= 2),
k AS (SELECT id, count(*) AS chunks, count(*) FILTER (WHERE o BETWEEN 2 AND 6) AS points FROM c GROUP BY id)
SELECT d.*, coalesce(chunks, 0) AS n_chunks, coalesce(points, 0) AS n_points FROM d LEFT JOIN k USING (id) WHERE corpus <> 'regulations'"""
SQL["r3_term_idf"] = f"WITH {DOCS}, {POSTS}, {IDF} SELECT term_id, df, round(idf, 6) AS idf FROM idf"
SQL["r4_sparse_search"] = f"{SPARSE} SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM sparse WHERE rank <= 10"
SQL["r5_dense_search"] = f"WITH {VEC}, qvec AS (SELECT * FROM vec WHERE CAST(id AS BIGINT) % 50 = 0), {DSCORED}, t AS ({topk('dscored', 10)}) SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM t"
SQL["r6_apply_filters"] = f"WITH {DOCS} SELECT id FROM docs WHERE doc_type = 'en' AND source = 'src3' AND NOT coalesce(contains_pii, false)"
FUSED = "f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM sparse UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY 1, 2)"
SQL["r7_rrf_fuse"] = f"{BOTH}, {FUSED}, t AS ({topk('f', 30)}) SELECT query_id, chunk_id, rank, score FROM t"
SQL["r8_hybrid_search"] = (
    f"WITH {DOCS.replace('docs AS', 'every AS')}, docs AS (SELECT * FROM every WHERE corpus = 'documents'), allowed AS (SELECT * FROM docs WHERE NOT coalesce(contains_pii, false)), {POSTS}, {IDF}, {ASKED}, {SCORED.replace('GROUP BY', 'WHERE chunk_id IN (SELECT id FROM allowed) GROUP BY')}, sparse AS ({topk('scored', 30)}), "
    f"{VEC}, {QVEC}, dscored AS (SELECT q.id AS query_id, c.id AS chunk_id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM qvec q, vec c WHERE c.id IN (SELECT id FROM allowed)), dense AS ({topk('dscored', 30)}), {FUSED}, t AS ({topk('f', 8)}) SELECT query_id, chunk_id, rank, score FROM t"
)
SQL["r9_rerank"] = f"{SPARSE}, t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id <> 'q3' THEN length(chunk_id) END DESC NULLS LAST, rank) AS r FROM sparse) SELECT query_id, chunk_id, CAST(r AS INT) AS rank FROM t WHERE r <= 8"
SQL["r10_entity_search"] = f"""{HITDOC}, own AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scored JOIN docs ON docs.id = chunk_id WHERE source = 'src1' QUALIFY r <= 10), nown AS (SELECT query_id, count(*) AS many FROM own GROUP BY 1),
e AS (SELECT query_id, chunk_id, 0 AS stage, r FROM own UNION ALL SELECT hd.query_id, hd.chunk_id, 1, hd.rank FROM hd LEFT JOIN nown USING (query_id) LEFT JOIN own USING (query_id, chunk_id) WHERE coalesce(many, 0) < 3 AND own.r IS NULL)
SELECT query_id, chunk_id, stage, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage, r, chunk_id) AS INT) AS rank FROM e QUALIFY rank <= 10"""
SQL["r11_depth_by_intent"] = f"{HITDOC} SELECT query_id, chunk_id, rank FROM hd WHERE rank <= CASE length(query_id) % 3 WHEN 0 THEN 12 WHEN 1 THEN 10 ELSE 8 END"
SQL["r12_search_in_documents"] = f"{HITDOC}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS k FROM scored JOIN docs ON docs.id = chunk_id WHERE source IN ('src0', 'src2', 'src5') QUALIFY k <= 2) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM o"
SQL["r13_prioritize_cited"] = f"{REGULATED}, c AS (SELECT 'q' || item_id AS query_id, item_id % 5 + 9 AS a FROM benchmark) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n % 5 + 9 = a THEN 0 ELSE 1 END, rank) AS INT) AS rank FROM rg JOIN c USING (query_id)"
DIVERSE = "SELECT *, row_number() OVER (PARTITION BY query_id, coalesce('s' || service, article_no) ORDER BY rank) AS k FROM "
SQL["r14_diversify"] = f"{REGULATED}, v AS ({DIVERSE} rg) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k > 2 THEN 1 ELSE 0 END, rank) AS INT) AS rank FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k > 2 THEN 1 ELSE 0 END, rank) <= 14"
SQL["r15_filter_org_type"] = f"{REGULATED} SELECT query_id, chunk_id, rank FROM rg WHERE service IS NULL OR n % 5 = 3"
SQL["r16_routing_candidates"] = f"{REGULATED}, k AS (SELECT * FROM rg WHERE rank <= 28 AND (service IS NULL OR n % 5 <> 3)), v AS ({DIVERSE} k) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k > 2 THEN 1 ELSE 0 END, rank) AS INT) AS rank FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k > 2 THEN 1 ELSE 0 END, rank) <= 14"
SQL["r17_group_by_document"] = f"{HITDOC} SELECT query_id, source AS filename, round(max(score), 4) AS score, count(*) AS n_hits, arg_min(substr(trim(regexp_replace(regexp_replace(text, '^\\[[^\\n]*\\]\\n', ''), '\\s+', ' ', 'g')), 1, 160), rank) AS sample FROM hd GROUP BY 1, 2"
SQL["r18_build_context"] = f"""{HITDOC}, c AS (SELECT query_id, md5(string_agg('--- Parca ' || rank || ' (' || filename || ', s.' || page || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context, string_agg(filename, '|' ORDER BY rank) AS sources FROM hd GROUP BY 1) SELECT * FROM c"""
SQL["r19_expand_to_parent"] = f"""{HITDOC}, p AS (SELECT source, min(text) AS t FROM docs GROUP BY 1), x AS (SELECT query_id, 'p' || hd.source AS unit_id, chunk_id, rank, md5(CASE WHEN hd.source = 'src4' THEN text ELSE t END) AS text FROM hd JOIN p USING (source))
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, unit_id ORDER BY rank) = 1"""
SQL["r20_embedding_backlog"] = f"WITH {FLOW}, {CHUNKS} SELECT c.id, c.doc_id FROM chunks c JOIN flow ON flow.id = c.doc_id WHERE corpus = 'regulations' AND kind = 'child' AND c.id NOT IN (SELECT id FROM chunks WHERE section = 'F')"
SQL["r21_embed"] = docs_sql("CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS spaces")

# routing
SQL["d1_service_catalog"] = f"""WITH {SERVICES}, c AS (SELECT service, unit, sub_unit, CAST(c_custkey % 9 + 8 AS VARCHAR) AS article_no FROM customer JOIN svc ON nk = c_nationkey WHERE c_custkey % 2 = 0 AND c_custkey % 5 > 0)
SELECT service, unit, sub_unit, min(article_no) AS article_no FROM c GROUP BY ALL"""
VERIFY = f"""WITH {HITS}, {DECS}, known AS (SELECT decision_id, list(DISTINCT article_no) AS a FROM hits GROUP BY 1),
v AS (SELECT decs.*, list_filter(cited, lambda c: list_contains(a, regexp_extract(c, '[0-9]+'))) AS good, list_filter(cited, lambda c: NOT list_contains(a, regexp_extract(c, '[0-9]+'))) AS bad FROM decs JOIN known USING (decision_id)),
w AS (SELECT *, NOT undetermined AND len(good) = 0 AS falls FROM v)"""
SQL["d2_verify_citations"] = f"""{VERIFY} SELECT decision_id, CASE WHEN NOT falls THEN main_unit END AS main_unit, CASE WHEN NOT falls THEN other_unit END AS other_unit, CASE WHEN NOT falls THEN service END AS service,
array_to_string(CASE WHEN undetermined THEN cited ELSE good END, ',') AS cited, CASE WHEN falls THEN 0 ELSE confidence END AS confidence, undetermined OR falls AS undetermined, CASE WHEN undetermined THEN '' ELSE array_to_string(bad, ',') END AS invented,
CASE WHEN falls THEN 'Kararin dayandirildigi madde(ler) (' || array_to_string(bad, ', ') || ') getirilen yonetmelik parcalarinda bulunmadi; dogrulanamayan atifla servis atamasi yapilmadi.' ELSE reasoning END AS reasoning FROM w"""


def owners(decs):
    """Services that the citation paths of decisions name."""
    return f"""paths AS (SELECT decision_id, string_split(c, '-') AS p FROM (SELECT decision_id, unnest(cited) AS c FROM {decs} WHERE NOT undetermined) WHERE contains(c, '-')),
owned AS (SELECT DISTINCT decision_id, h.service FROM paths JOIN hits h USING (decision_id) WHERE h.article_no = p[1] AND h.service_no = p[-1] AND (p[2] NOT IN ('A', 'B', 'C') OR starts_with(h.unit, p[2] || ')')) AND starts_with(h.sub_unit, p[3] || '-'))"""


def reconciled(decs):
    """Decisions with service and units as the hits have them."""
    return f"""{owners(decs)}, ow AS (SELECT decision_id, list(service) AS s FROM owned GROUP BY 1), a AS (SELECT d.*, s, NOT undetermined AND service IS NOT NULL AS active FROM {decs} d LEFT JOIN ow USING (decision_id)),
b AS (SELECT *, CASE WHEN active AND len(s) = 1 AND {norm('s[1]')} <> {norm('service')} THEN s[1] ELSE service END AS svc2 FROM a),
m AS (SELECT b.decision_id, arg_min(struct_pack(service := h.service, unit := h.unit, sub := h.sub_unit), (CASE WHEN {norm('h.service')} = {norm('svc2')} THEN 0 ELSE 100 END) + h.rank) AS hit FROM b JOIN hits h USING (decision_id) WHERE active AND ({norm('h.service')} = {norm('svc2')} OR {same_service('h.service', 'svc2')}) GROUP BY 1),
r AS (SELECT b.*, hit, CASE WHEN hit IS NULL THEN main_unit WHEN starts_with(hit.unit, 'B') THEN NULL ELSE CASE split_part(hit.sub, '-', 1) WHEN 'I' THEN 'Vergilendirme' WHEN 'II' THEN 'Muhasebe' WHEN 'III' THEN 'Kovusturma' ELSE 'Tarama ve Kontrol' END END AS mu,
  CASE WHEN hit IS NULL THEN other_unit END AS ou, coalesce(hit.service, svc2) AS s3 FROM b LEFT JOIN m USING (decision_id)),
rec AS (SELECT decision_id, mu AS main_unit, ou AS other_unit, s3 AS service, array_to_string(cited, ',') AS cited, confidence, undetermined, active AND (s3 IS DISTINCT FROM service OR mu IS DISTINCT FROM main_unit OR ou IS DISTINCT FROM other_unit) AS corrected FROM r)"""


SQL["d3_cited_services"] = f"WITH {HITS}, {DECS}, {owners('decs')} SELECT decision_id, string_agg(service, '|' ORDER BY service) AS services FROM owned GROUP BY 1"
SQL["d4_reconcile_units"] = f"WITH {HITS}, {DECS}, {reconciled('decs')} SELECT * FROM rec"
SQL["d5_flag_uncertain"] = f"WITH {HITS}, {DECS} SELECT decision_id, len(list_filter(cited, lambda c: list_contains(a, regexp_extract(c, '[0-9]+')))) > 0 AS uncertain FROM (SELECT decs.*, coalesce(a, []) AS a FROM decs LEFT JOIN (SELECT decision_id, list(article_no) AS a FROM hits WHERE NOT certain GROUP BY 1) USING (decision_id))"
NOTE = "chr(10) || chr(10) || '[Otomatik kontrol] Karar \"' || {} || '\" adını gösteriyor; yönetmelik kataloğunda böyle bir servis yok. Evrak manuel incelemeye alındı.'"
SQL["d6_enforce_catalog"] = f"""WITH {SERVICES}, {DECS}, w AS (SELECT *, NOT undetermined AND service IS NOT NULL AND service NOT IN (SELECT service FROM svc WHERE nk % 2 = 0) AS falls FROM decs)
SELECT decision_id, CASE WHEN NOT falls THEN main_unit END AS main_unit, CASE WHEN NOT falls THEN other_unit END AS other_unit, CASE WHEN NOT falls THEN service END AS service, CASE WHEN falls THEN '' ELSE array_to_string(cited, ',') END AS cited,
CASE WHEN falls THEN 0 ELSE confidence END AS confidence, undetermined OR falls AS undetermined, CASE WHEN falls THEN reasoning || {NOTE.format('service')} ELSE reasoning END AS reasoning FROM w"""
SQL["d7_repair_routing"] = f"""WITH {FLOW}, w AS (SELECT *, corpus = 'documents' AND coalesce(routed_service = '5-LOW', false) AS bad FROM flow) SELECT id, CASE WHEN NOT bad THEN routed_service END AS routed_service, CASE WHEN NOT bad THEN routed_unit END AS routed_unit,
CASE WHEN bad THEN 0 ELSE routing_confidence END AS routing_confidence, CASE WHEN bad THEN 'belirlenemedi' ELSE routing_status END AS routing_status, CASE WHEN bad THEN routing_reasoning || {NOTE.format('routed_service')} ELSE routing_reasoning END AS routing_reasoning FROM w"""
SQL["d8_apply_decisions"] = f"""WITH {SERVICES}, {FLOW}, {DECS}, w AS (SELECT flow.*, d.k IS NOT NULL AS hit, d.undetermined AS un, d.service AS ds, coalesce(d.main_unit, d.other_unit) AS du, d.confidence AS dc, d.routing_key AS dk FROM flow LEFT JOIN decs d ON d.decision_id = flow.id)
SELECT id, CASE WHEN hit AND NOT un THEN ds WHEN NOT hit THEN routed_service END AS routed_service, CASE WHEN hit AND NOT un THEN du WHEN NOT hit THEN routed_unit END AS routed_unit, CASE WHEN hit THEN dc ELSE routing_confidence END AS routing_confidence,
CASE WHEN hit AND un THEN 'belirlenemedi' WHEN hit THEN 'routed' ELSE routing_status END AS routing_status, coalesce(dk, routing_key) AS routing_key, CASE WHEN hit AND lifecycle_status = 'new' THEN 'routed' ELSE lifecycle_status END AS lifecycle_status FROM w"""
SQL["d9_apply_manual"] = f"""WITH {FLOW}, o AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, max({{'at': l_linenumber, 's': CASE l_linenumber % 3 WHEN 1 THEN '1-URGENT' ELSE '2-HIGH' END, 'r': CASE WHEN l_linestatus = 'F' THEN 'neden' ELSE '' END}}) AS m FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY 1)
SELECT flow.id, CASE WHEN o.id IS NOT NULL THEN m.s ELSE routed_service END AS routed_service, CASE WHEN o.id IS NULL THEN routing_reasoning WHEN m.r = '' THEN 'Servis calisani tarafindan elle atandi' ELSE m.r END AS routing_reasoning, CASE WHEN o.id IS NOT NULL THEN 1 ELSE routing_confidence END AS routing_confidence, CASE WHEN o.id IS NOT NULL THEN 'routed' ELSE routing_status END AS routing_status FROM flow LEFT JOIN o USING (id)"""
SQL["d10_grading"] = f"""WITH {SERVICES}, {DECS}, t AS (SELECT *, unnest([1, 2]) AS attempt FROM decs), v AS (SELECT *, CASE WHEN attempt = 2 THEN service || ' B' ELSE service END AS s, undetermined OR ((k + attempt) % 3 > 0 AND k % 7 <> 0) AS approved FROM t),
p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY approved DESC, attempt) = 1)
SELECT decision_id, CASE WHEN approved THEN main_unit END AS main_unit, CASE WHEN approved THEN other_unit END AS other_unit, CASE WHEN approved THEN s END AS service, CASE WHEN approved THEN array_to_string(cited, ',') ELSE '' END AS cited, CASE WHEN approved THEN confidence ELSE 0 END AS confidence, undetermined OR NOT approved AS undetermined, CAST(attempt AS INT) AS attempt, approved FROM p"""
SQL["d10_grading_context"] = f"""WITH {HITS}, {DECS}, m AS (SELECT h.decision_id, h.rank, h.service, {same_service('h.service', "coalesce(d.service, '')")} AS own FROM hits h JOIN decs d USING (decision_id) WHERE NOT undetermined) SELECT decision_id, rank, service FROM m QUALIFY own OR NOT bool_or(own) OVER (PARTITION BY decision_id)"""

# queues, archives, audits
COUNTS = f"SELECT routed_service AS service, routed_unit AS unit, count(*) FILTER (WHERE lifecycle_status <> 'completed') AS pending, count(*) FILTER (WHERE lifecycle_status = 'completed') AS completed FROM flow WHERE {OFFICIAL} AND routing_status <> 'pending' GROUP BY 1, 2"
SQL["a1_service_queue_counts"] = f"WITH {FLOW} {COUNTS}"
SQL["a2_service_queue"] = f"WITH {FLOW} SELECT routed_service, CAST(row_number() OVER (PARTITION BY routed_service ORDER BY lifecycle_status = 'completed', created_at DESC, id) AS INT) AS position, id FROM flow WHERE {OFFICIAL} AND (routed_service IS NOT NULL OR routing_status = 'belirlenemedi') QUALIFY position <= 100"
BOARD = f"""WITH {FLOW}, cat AS (SELECT DISTINCT o_orderpriority AS service, 'A) Ana ' || substr(o_orderpriority, 1, 1) AS unit, CASE WHEN starts_with(o_orderpriority, '2') THEN '12' ELSE '11' END AS article_no FROM orders),
cnt AS (SELECT service, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(completed) AS BIGINT) AS completed FROM ({COUNTS}) GROUP BY 1),
board AS (SELECT cat.service, unit, article_no, coalesce(pending, 0) AS pending, coalesce(completed, 0) AS completed FROM cat LEFT JOIN cnt ON cnt.service = cat.service WHERE article_no <> '12' UNION ALL SELECT NULL, NULL, NULL, coalesce((SELECT pending FROM cnt WHERE service IS NULL), 0), 0)"""
SQL["a3_service_board"] = f"{BOARD} SELECT * FROM board"
SQL["a4_unit_rollup"] = f"""{BOARD} SELECT 'unit' AS level, substr(unit, 4) AS unit, 0 AS place, count(*) AS services, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(completed) AS BIGINT) AS completed FROM board WHERE service IS NOT NULL GROUP BY 2
UNION ALL SELECT 'total', NULL, 2, count(service), CAST(sum(pending) AS BIGINT), CAST(sum(completed) AS BIGINT) FROM board"""
KEYED = "keyed AS (SELECT *, coalesce(routed_service, '(belirlenemedi)') AS named FROM flow WHERE corpus = 'documents' AND routing_status <> 'pending')"
SQL["a5_routing_inconsistencies"] = f"WITH {FLOW}, {KEYED} SELECT routing_key, array_to_string(list_sort(list(DISTINCT named)), '|') AS services, md5(string_agg(concat_ws('=', filename, routed_service), '|' ORDER BY filename, routed_service NULLS FIRST)) AS files, count(*) AS n_files FROM keyed WHERE routing_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT named) > 1"
SQL["a5_inconsistent_files"] = f"WITH {FLOW}, {KEYED} SELECT routing_key, filename, routed_service AS service FROM keyed WHERE routing_key IS NOT NULL AND routing_key IN (SELECT routing_key FROM keyed GROUP BY 1 HAVING count(DISTINCT named) > 1)"
SQL["a6_routing_key_report"] = f"WITH {FLOW}, {KEYED} SELECT routing_key, count(*) AS n_docs, CASE WHEN routing_key IS NULL THEN '' ELSE array_to_string(list_sort(list(DISTINCT named)), '|') END AS services FROM keyed GROUP BY 1"
ARCHIVE = f"WITH {FLOW}, {LETTERS}, lt AS (SELECT document_id, arg_max(decision, created_at::VARCHAR || id || decision) AS d FROM letters GROUP BY 1), a AS (SELECT * FROM flow WHERE {OFFICIAL} AND lifecycle_status {{}} 'completed' ORDER BY {{}} DESC NULLS LAST, id LIMIT 200) SELECT id, {{}}, coalesce(completed_decision, d) AS last_decision FROM a LEFT JOIN lt ON document_id = id"
SQL["a7_archive_done"] = ARCHIVE.format("=", "completed_at", "completed_at")
SQL["a7_archive_open"] = ARCHIVE.format("<>", "created_at", "created_at")
SQL["a8_archive_counts"] = f"WITH {FLOW} SELECT count(*) FILTER (WHERE lifecycle_status = 'completed') AS completed, count(*) FILTER (WHERE lifecycle_status <> 'completed') AS pending FROM flow WHERE {OFFICIAL}"
SQL["a9_document_buckets"] = f"WITH {FLOW} SELECT CASE lifecycle_status WHEN 'completed' THEN 'answered' WHEN 'in_progress' THEN 'in_progress' ELSE 'suggestions' END AS bucket, count(*) AS n FROM flow WHERE {OFFICIAL} GROUP BY 1"
SQL["a10_status_counts"] = f"WITH {FLOW} SELECT status, count(*) AS n FROM flow GROUP BY ROLLUP (status)"
SQL["a10_recent_failures"] = f"WITH {FLOW} SELECT id, filename, error, updated_at FROM flow WHERE status = 'failed' ORDER BY updated_at DESC, id LIMIT 10"
KIDS = "kids AS (SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE embedded_at IS NULL) AS w FROM chunks WHERE kind = 'child' GROUP BY 1)"
SQL["a11_document_list"] = f"WITH {FLOW}, {CHUNKS}, {KIDS} SELECT id, filename, status, format, coalesce(c, 0) AS chunk_count FROM flow LEFT JOIN kids ON doc_id = id WHERE filename ILIKE '%EVRAK-1%'"
SQL["a12_readiness"] = f"WITH {FLOW}, {CHUNKS}, {KIDS} SELECT CASE WHEN n % 6 = 0 THEN path || '?' ELSE path END AS path, CASE WHEN n % 6 > 0 THEN id END AS id, CASE WHEN n % 6 > 0 THEN filename END AS filename, CASE WHEN n % 6 > 0 THEN routed_service END AS routed_service, CASE WHEN n % 6 = 0 THEN 'queued' WHEN status = 'failed' THEN 'failed' WHEN c > 0 AND w = 0 THEN 'ready' ELSE 'processing' END AS stage FROM flow LEFT JOIN kids ON doc_id = id"
SQL["a13_classification_samples"] = f"WITH {FLOW}, {CHUNKS}, t AS (SELECT doc_id, ordinal, text FROM chunks WHERE kind = 'child' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, text) <= 3), s AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal, text) AS s FROM t GROUP BY 1) SELECT id, filename, coalesce(s, '') AS sample FROM flow LEFT JOIN s ON doc_id = id WHERE status = 'parsed' AND corpus = 'documents' AND classified_at IS NULL"
SQL["a14_gap_scan_backlog"] = f"WITH {FLOW} SELECT id FROM flow WHERE {OFFICIAL} AND parsed_path IS NOT NULL AND gaps_scanned_at IS NULL"
SQL["a14_pipeline_backlog"] = f"WITH {FLOW} SELECT id FROM flow WHERE {OFFICIAL} AND status = 'parsed' AND routing_status = 'pending'"
SQL["a15_classification_summary"] = f"WITH {DOCS} SELECT count(*) FILTER (WHERE n % 9 > 0) AS ok, count(*) FILTER (WHERE n % 9 = 0) AS failed, count(*) FILTER (WHERE contains_pii) AS pii, count(*) FILTER (WHERE n % 10 < 6) AS low_confidence FROM docs"
SQL["a15_gap_summary"] = "SELECT l_orderkey AS id, CAST(count(*) AS INT) AS n_findings, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INT) AS n_critical FROM lineitem GROUP BY 1"
SQL["a16_chunk_preview"] = f"WITH {FLOW}, {CHUNKS} SELECT doc_id, filename, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind DESC, ordinal, section NULLS FIRST, text, token_count) AS INT) AS line, kind, section, token_count, text FROM chunks JOIN flow ON flow.id = doc_id WHERE filename ILIKE '%evrak-12%'"
POINTS = f"WITH {FLOW}, {CHUNKS}, pts AS (SELECT CASE WHEN CAST(doc_id AS BIGINT) % 29 = 0 THEN id || 'x' ELSE id END AS id, CASE WHEN CAST(doc_id AS BIGINT) % 31 = 0 THEN doc_id || 'x' ELSE doc_id END AS doc_id FROM chunks WHERE kind = 'child'), orph AS (SELECT id, doc_id, 'no document' AS reason FROM pts WHERE doc_id NOT IN (SELECT id FROM flow) UNION ALL SELECT id, doc_id, 'no chunk' FROM pts WHERE doc_id IN (SELECT id FROM flow) AND id NOT IN (SELECT id FROM chunks))"
SQL["a17_index_orphans"] = f"{POINTS} SELECT * FROM orph"
SQL["a18_drop_orphans"] = f"{POINTS} SELECT doc_id, count(*) AS n FROM pts WHERE id NOT IN (SELECT id FROM orph) GROUP BY 1"
SQL["a19_corpus_inventory"] = f"WITH {FLOW}, {CHUNKS}, {LETTERS}, own AS (SELECT id FROM flow WHERE corpus = 'regulations') SELECT 'documents' AS table_name, count(*) AS n FROM own UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id IN (SELECT id FROM own) UNION ALL SELECT 'letters', count(*) FROM letters WHERE document_id IN (SELECT id FROM own)"
SQL["a20_purge_corpus"] = f"WITH {FLOW}, {CHUNKS}, {LETTERS}, own AS (SELECT id FROM flow WHERE corpus = 'regulations') SELECT 'documents' AS table_name, count(*) AS n FROM flow WHERE corpus <> 'regulations' UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT id FROM own) UNION ALL SELECT 'letters', count(*) FROM letters WHERE document_id NOT IN (SELECT id FROM own)"
SQL["a21_backfill_lifecycle"] = f"WITH {FLOW} SELECT CASE WHEN lifecycle_status = 'new' AND routing_status = 'routed' THEN 'routed' ELSE lifecycle_status END AS lifecycle_status, routing_status, count(*) AS n FROM flow GROUP BY 1, 2"
SQL["a21_backfill_sessions"] = f"""WITH {FLOW}, u AS (SELECT CAST(l_orderkey - l_orderkey % 10 + 3 AS VARCHAR) AS id, min('u' || l_linenumber) AS s FROM lineitem GROUP BY 1), b AS (SELECT flow.*, coalesce(session_id, s) AS sid, coalesce(session_id, s) IS NOT NULL AND routing_status <> 'pending' AS wrong FROM flow LEFT JOIN u USING (id))
SELECT id, sid AS session_id, CASE WHEN NOT wrong THEN routed_service END AS routed_service, CASE WHEN wrong THEN 'pending' ELSE routing_status END AS routing_status, CASE WHEN wrong THEN 'new' ELSE lifecycle_status END AS lifecycle_status, CASE WHEN NOT wrong THEN routing_key END AS routing_key FROM b"""
SQL["a22_session_documents"] = f"WITH {FLOW} SELECT id FROM flow WHERE session_id = 's3' AND id <> '23'"

# chat, letters, evaluation
SQL["m1_chat_history"] = f"WITH {MSG}, t AS (SELECT * FROM msg QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seq DESC) <= 3) SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY seq) AS INT) AS place, seq, role, md5(content) AS content FROM t"
SQL["m2_chat_exchanges"] = f"WITH {MSG}, t AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS a FROM msg WINDOW w AS (PARTITION BY document_id ORDER BY seq)) SELECT document_id, seq, md5(content) AS question, md5(a) AS answer FROM t WHERE role = 'user' AND nr = 'assistant'"
SQL["m2_append_exchange"] = f"WITH {MSG}, l AS (SELECT document_id, max(seq) AS m FROM msg WHERE document_id % 2 = 1 GROUP BY 1) SELECT document_id, seq, role, md5(content) AS content FROM msg UNION ALL SELECT document_id, m + 1, 'user', md5('soru') FROM l UNION ALL SELECT document_id, m + 2, 'assistant', md5('cevap') FROM l"
SQL["m3_letters_by_document"] = f"WITH {LETTERS} SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM letters"
SQL["m4_assign_letter_numbers"] = f"WITH {LETTERS} SELECT id, 47 + row_number() OVER (ORDER BY created_at, id) AS letter_no FROM letters WHERE saved UNION ALL SELECT id, NULL FROM letters WHERE NOT saved"
# three attempts a document; those for a refusal without a reason are void
SQL["m6_select_draft"] = f"""WITH {DOCS}, tried AS (SELECT id, n, k, text, trim(regexp_replace(replace('**' || {words('text', 1, 4)} || '** ' || CASE WHEN (n + k) % 3 = 0 THEN '98.765' ELSE '' END, '**', ''), '\\s+', ' ', 'g')) AS para, CASE WHEN n % 2 > 0 THEN '' WHEN n % 4 = 0 THEN 'insan' WHEN k > 1 THEN 'model' END AS reason FROM docs, unnest([1, 2, 3]) AS u(k)),
nums AS (SELECT id, k, regexp_extract_all(para || {NL} || reason, {lit(NUMBER)}) AS nums, list_transform(regexp_extract_all(text, {lit(NUMBER)}), lambda x: {digits('x')}) AS known, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM tried WHERE reason IS NOT NULL),
u AS (SELECT id, k, known, flat, i, nums[i] AS x, {digits('nums[i]')} AS d FROM nums, unnest(range(1, len(nums) + 1)) AS v(i)),
bad AS (SELECT id, k, x, min(i) AS i FROM u WHERE len(d) >= 2 AND NOT contains(flat, x) AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(known) AS k) WHERE {_SUPPORTED}) GROUP BY ALL),
un AS (SELECT id, k, string_agg(x, '|' ORDER BY i) AS unsupported FROM bad GROUP BY ALL)
SELECT id AS document_id, k AS attempt, reason, coalesce(unsupported, '') AS unsupported, para AS paragraphs FROM tried LEFT JOIN un USING (id, k) WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY unsupported IS NOT NULL, CASE WHEN unsupported IS NULL THEN k ELSE -k END) = 1"""
SQL["m7_number_source"] = docs_sql("md5(concat_ws(chr(10), source, 'ozet', '', id || chr(10) || doc_type || chr(10) || 'A' || chr(10) || 'B', '1', '11' || chr(10) || 't', '', text)) AS source")
GRADED = f"""WITH {DOCS}, golden AS (SELECT 'g' || item_id AS id, CASE WHEN item_id % 5 = 0 THEN 'trap' ELSE 'entity' END AS scenario, CASE WHEN item_id % 3 > 0 THEN 'SRC' || (item_id % 20) || '/' END AS doc, CASE WHEN item_id % 4 > 0 THEN upper({words('text', 1, 1)}) END AS e1, {words('text', 2, 1)} AS e2, CASE WHEN item_id % 6 = 0 THEN {words('text', 3, 1)} END AS f FROM benchmark),
ans AS (SELECT 't' || (n // 40) AS target, 'g' || (n % 40) AS id, CASE WHEN n % 9 > 0 THEN CASE WHEN n % 10 = 0 THEN 'Bilgi BULUNAMADI. ' ELSE '' END || text END AS answer, filename, CASE WHEN n % 9 = 0 THEN 'zaman asimi' END AS error FROM docs),
j AS (SELECT t.target, g.*, answer, filename, coalesce(error, 'cevap yok') AS error, answer IS NOT NULL AS ok, {low('answer')} AS l FROM (SELECT DISTINCT target FROM ans) t CROSS JOIN golden g LEFT JOIN ans ON ans.target = t.target AND ans.id = g.id),
graded AS (SELECT target, id, scenario, CASE WHEN doc IS NOT NULL THEN coalesce(ok AND contains({low('filename')}, {low('doc')}), false) END AS source_hit, CASE WHEN scenario = 'trap' THEN coalesce(ok AND regexp_matches({plain('answer')}, {lit('|'.join(NOT_FOUND))}), false) END AS trap_passed,
 CASE WHEN e1 IS NOT NULL THEN coalesce(ok AND contains(l, {low('e1')}) AND contains(l, {low('e2')}), false) END AS answer_hit, CASE WHEN ok AND f IS NOT NULL THEN contains(l, {low('f')}) END AS forbidden_hit, ok, error FROM j)"""
SQL["e1_grade_answers"] = f"{GRADED} SELECT target, id, scenario, source_hit, trap_passed, answer_hit, forbidden_hit FROM graded"
SQL["e2_grade_failure"] = f"{GRADED} SELECT target, id, source_hit, trap_passed, answer_hit, forbidden_hit, 'HATA: ' || error AS snippet FROM graded WHERE NOT ok"
RATES = "round(coalesce(avg(CAST(source_hit AS INT)), 0), 6) AS source_rate, round(coalesce(avg(CAST(trap_passed AS INT)), 0), 6) AS trap_rate, round(coalesce(avg(CAST(answer_hit AS INT)), 0), 6) AS answer_rate, round(coalesce(1 - avg(CAST(forbidden_hit AS INT)), 1), 6) AS clean_rate"
SQL["e3_summarize"] = f"{GRADED} SELECT {RATES} FROM graded"
SQL["e4_compare_targets"] = f"{GRADED} SELECT target, {RATES} FROM graded GROUP BY 1"

# streams
SQL["w1_ingest"] = r"""WITH t AS (SELECT doc_id, text, doc_id % 3 = 0 AS c, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(10) || '# Ek' || chr(10) || chr(10) || 'sonradan gelen' ELSE text END AS now FROM documents WHERE text IS NOT NULL)
SELECT doc_id, true AS named, sha256(now) AS hash, strlen(now) AS size_bytes, 'parsed' AS status, c AS updated, CASE WHEN c OR regexp_matches(text, '\S') THEN c END AS changed FROM t"""
SQL["w2_pending_jobs"] = "WITH e AS (SELECT user_id AS job_id, ts, CASE WHEN event_type IN ('error', 'purchase') THEN 'done' ELSE 'queued' END AS event FROM events), l AS (SELECT *, lag(event) OVER (PARTITION BY job_id ORDER BY ts, event) AS b FROM e) SELECT job_id, count(*) AS runs, min(ts) AS first_at FROM l WHERE event = 'queued' AND (b IS NULL OR b = 'done') GROUP BY 1"
SQL["w3_lifecycle_state"] = """WITH e AS (SELECT user_id * 10 + event_id % 10 AS document_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS r FROM events)
SELECT document_id, ['new', 'routed', 'in_progress', 'completed'][max(r) + 1] AS lifecycle_status, min(ts) FILTER (WHERE r = 3) AS completed_at, CASE WHEN arg_min(event_id, ts) FILTER (WHERE r = 3) % 2 = 0 THEN 'onay' END AS completed_decision FROM e GROUP BY 1"""
SQL["w4_session_registry"] = "SELECT user_id % 20 AS session_id, event_id % 50 AS document_id, min(ts) + INTERVAL 12 HOUR AS expires_at, min(ts) + INTERVAL 12 HOUR > TIMESTAMP '2024-01-01 14:00:00' AS active FROM events GROUP BY 1, 2"
SQL["w5_split_official"] = f"WITH {FLOW} SELECT 'official' AS part, count(*) AS n FROM flow WHERE session_id IS NULL UNION ALL SELECT 'attached', count(*) FROM flow WHERE session_id IS NOT NULL"

SQL["p2_routing_queries"] = f"WITH {DOCS} SELECT DISTINCT doc_type || '|' || {REQUESTS}[n % 9 + 1] || '|' || source AS id, {PHRASES}[n % 9 + 1] || ' ' || source AS text FROM docs"
KIDS_AS_DOCS = f"{CHILDREN}, kd AS (SELECT sha256(c.id || ':child:' || ordinal) AS id, filename, crumb || c.body AS text FROM children c JOIN parents p USING (id) JOIN docs USING (id))"
SQL["p1_search_files"] = f"""WITH RECURSIVE {KIDS_AS_DOCS}, {POSTS.replace('FROM docs', 'FROM kd')}, {IDF.replace('FROM docs', 'FROM kd')}, {ASKED}, {SCORED}, sparse AS ({topk('scored', 10)})
SELECT query_id, filename, round(max(score), 3) AS score, count(*) AS n_hits FROM sparse JOIN kd ON kd.id = chunk_id GROUP BY 1, 2"""
SQL["p3_checked_decisions"] = f"""{VERIFY}, checked AS (SELECT decision_id, CASE WHEN NOT falls THEN main_unit END AS main_unit, CASE WHEN NOT falls THEN other_unit END AS other_unit, CASE WHEN NOT falls THEN service END AS service, CASE WHEN undetermined THEN cited ELSE good END AS cited, CASE WHEN falls THEN 0 ELSE confidence END AS confidence, undetermined OR falls AS undetermined FROM w),
{reconciled('checked')}, final AS (SELECT *, NOT undetermined AND service IS NOT NULL AND service NOT IN (SELECT service FROM svc) AS outside FROM rec)
SELECT decision_id, CASE WHEN NOT outside THEN main_unit END AS main_unit, CASE WHEN NOT outside THEN other_unit END AS other_unit, CASE WHEN NOT outside THEN service END AS service, CASE WHEN outside THEN '' ELSE cited END AS cited, CASE WHEN outside THEN 0 ELSE confidence END AS confidence, undetermined OR outside AS undetermined, corrected FROM final"""
