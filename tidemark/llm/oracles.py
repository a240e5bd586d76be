"""DuckDB SQL with the rows of those queries that SQL can express."""

from tidemark.llm.chat import PIECE, whole_pieces
from tidemark.llm.tokens import default_path

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, source, body, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS k FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, source, body, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS norm
      FROM (SELECT doc_id, source, body, unnest(lines) AS line FROM w)),
h AS (SELECT source, count(DISTINCT body) AS host_docs FROM d GROUP BY source),
f AS (SELECT l.source, norm FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source
      GROUP BY l.source, norm, host_docs HAVING count(DISTINCT body) > 20 AND count(DISTINCT body) > 0.002 * host_docs),
r AS (SELECT doc_id, sum(len(string_split(l.norm, ' '))) AS gone FROM l JOIN f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_line_words_removed
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_line_words_removed >= 10 AND n_words - n_line_words_removed >= 0.2 * n_words AS kept,
       n_line_words_removed
FROM b
"""

CONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS d, list_slice(w, j, j + least(len(w), 13) - 1) AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS j FROM bw WHERE len(w) > 0)),
depth AS (SELECT DISTINCT d FROM win),
dg AS (SELECT doc_id, i, d, list_slice(w, i, i + d - 1) AS g FROM (SELECT doc_id, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM dw, depth WHERE len(w) >= d)),
occ AS (SELECT doc_id, i, d, g FROM dg WHERE g IN (SELECT g FROM win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + d)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ JOIN win USING (g)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

CHAT = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10)
                || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS drawn FROM c),
v AS (SELECT DISTINCT unnest(string_split('{VOCABULARY}', chr(10))) AS piece),
k AS (SELECT drawn, sum(CASE WHEN v.piece IS NULL THEN strlen(x.piece) ELSE 1 END) AS tok
      FROM (SELECT drawn, unnest(regexp_extract_all(drawn, '{PIECE}')) AS piece FROM (SELECT DISTINCT drawn FROM e)) x LEFT JOIN v ON v.piece = x.piece GROUP BY drawn),
t AS (SELECT conv_id, row_number() OVER w - 1 AS i, role, text, tok,
             24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
      FROM e JOIN k USING (drawn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, coalesce(sum(tok) OVER b, 0) AS tb, coalesce(sum(chars) OVER b, 0) AS cb, first_value(role) OVER w = 'system' AS sys,
             first_value(tok) OVER w AS tok0, first_value(chars) OVER w AS chars0
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i), b AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT p.conv_id, p.i, coalesce(max(p.i - q.i), 0) AS h FROM p LEFT JOIN p q ON p.conv_id = q.conv_id AND q.i < p.i AND q.i >= p.i - 4 AND q.i >= CAST(p.sys AS INT)
        AND p.tb - q.tb <= 256 AND p.tb - q.tb + p.tok + CASE WHEN p.sys THEN p.tok0 ELSE 0 END <= 1024 GROUP BY p.conv_id, p.i),
ph AS (SELECT p.*, h.h, p.tb - q.tb AS ht, p.cb - q.cb AS hc FROM p JOIN h USING (conv_id, i) JOIN p q ON q.conv_id = p.conv_id AND q.i = p.i - h.h),
r AS (SELECT conv_id, i, CAST(tok AS BIGINT) AS used, true AS opens FROM ph WHERE i = 0
      UNION ALL
      SELECT ph.conv_id, ph.i, CAST(CASE WHEN r.used + tok <= 1024 THEN r.used + tok ELSE CASE WHEN sys THEN tok0 ELSE 0 END + ht + tok END AS BIGINT), r.used + tok > 1024
      FROM r JOIN ph ON ph.conv_id = r.conv_id AND ph.i = r.i + 1),
f AS (SELECT conv_id, CAST(sum(chars + CASE WHEN opens AND i > 0 THEN hc + CASE WHEN sys THEN chars0 ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars,
             CAST(count(*) FILTER (opens) AS BIGINT) AS n_windows FROM r JOIN ph USING (conv_id, i) GROUP BY conv_id)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows
FROM p JOIN f USING (conv_id) GROUP BY conv_id
"""


def chat_sql() -> str:
    """``CHAT`` with the vocabulary's pieces in it."""
    quoted = lambda x: x.replace("'", "''")
    return CHAT.replace("{VOCABULARY}", quoted("\n".join(whole_pieces(default_path())))).replace("{PIECE}", quoted(PIECE))
