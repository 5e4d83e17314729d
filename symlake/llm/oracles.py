"""DuckDB SQL for the opN_ queries that SQL can express."""

from ._common import LOWER, UPPER

_OP1 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 6) AS BIGINT) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM sources),
filled AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS remains,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS sharing
  FROM weighted
  WINDOW before AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max(CAST(remains AS DOUBLE) / CAST(sharing AS DOUBLE)) FILTER (weight * (CAST(remains AS DOUBLE) / CAST(sharing AS DOUBLE)) <= cap) AS height FROM filled),
shares AS (
  SELECT source, source_size,
         CASE WHEN height IS NULL OR weight * height > cap THEN CAST(cap AS DOUBLE) ELSE weight * height END AS target
  FROM weighted, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM shares),
wanted AS (
  SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS wanted FROM plan),
bins AS (
  SELECT source, place, CAST(sum(size) AS BIGINT) AS n FROM docs GROUP BY source, place),
ends AS (
  SELECT source, place, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY place) AS BIGINT) - n AS before FROM bins),
last AS (
  SELECT w.source, e.place, e.n, e.before, w.wanted FROM wanted w JOIN ends e ON w.source IS NOT DISTINCT FROM e.source
  WHERE e.before <= w.wanted AND w.wanted < e.before + e.n)
SELECT d.doc_id, d.size, w.source_size, w.target,
       CAST(w.whole * d.size + CASE WHEN d.place < l.place THEN d.size
            WHEN d.place = l.place THEN CAST(floor(d.size * (CAST(l.wanted - l.before AS DOUBLE) / l.n)) AS BIGINT) ELSE 0 END AS BIGINT) AS taken
FROM docs d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN last l ON d.source IS NOT DISTINCT FROM l.source
"""

_OP5 = f"""
WITH keyed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)
"""

_OP3 = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS own FROM documents),
lines AS (
  SELECT doc_id, generate_subscripts(own, 1) - 1 AS line, unnest(own) AS words FROM docs WHERE text IS NOT NULL),
paired AS (
  SELECT *, lead(words) OVER (PARTITION BY doc_id ORDER BY line) AS next FROM lines),
marked AS (
  SELECT doc_id, line, words, next,
         row_number() OVER (PARTITION BY words ORDER BY doc_id, line) > 1 AND len(regexp_extract_all(words, '[^\x20\x09-\x0D]+')) >= 1 AS single,
         next IS NOT NULL AND row_number() OVER (PARTITION BY words, next ORDER BY doc_id, line) > 1 AS pair
  FROM paired),
gone AS (
  SELECT doc_id, line, words, single OR pair OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY line), false) AS gone FROM marked),
cut AS (
  SELECT doc_id, count(*) AS lines, count(*) FILTER (gone) AS deleted, string_agg(words, chr(10) ORDER BY line) FILTER (NOT gone) AS text
  FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.lines, 0) AS lines, coalesce(c.deleted, 0) AS deleted, sha256(coalesce(c.text, '')) AS text_sha256
FROM documents d LEFT JOIN cut c USING (doc_id)
"""

_OP6 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counts AS (
  SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON e.vec_id = m.u LEFT JOIN counts c ON e.vec_id = c.u
"""

_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS seq
  FROM conversations),
seen AS (
  SELECT t.*, p.perspective, t.speaker = p.perspective AS own,
         '<|im_start|>' || CASE WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user name=' || regexp_replace(t.speaker, '[ \t\n\x0B\f\r<|>]+', '_', 'g') END || chr(10) AS head
  FROM turns t JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM turns) p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
pieces AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM seen),
placed AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY seq) AS BIGINT) AS "end" FROM pieces)
SELECT conv_id, perspective, seq, turn, speaker, piece, "end" - length(piece) AS start, "end" - length(piece) + length(head) AS learn_start,
       "end" - length(piece) + length(head) + CASE WHEN own THEN length(text) + 10 ELSE 0 END AS learn_end, "end"
FROM placed
"""

ORACLES = {"op1_mixing": _OP1, "op3_line_dedup": _OP3, "op5_exact_dedup": _OP5, "op6_embedding_near_dedup": _OP6, "op9_chat_formatting": _OP9}
