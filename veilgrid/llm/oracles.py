"""DuckDB SQL for the corpus operators whose results SQL can state."""

#: Lines of ``{docs}`` (doc_id, text) that line dedup deletes: numbered lines with a
#: word; windows of at least 50 words; the first place of each; runs along diagonals.
REMOVED_LINES = r"""
lines0 AS (
  SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM {docs}
),
lines1 AS (
  SELECT *, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS words FROM lines0
),
lines AS (
  SELECT doc, line, content, words, row_number() OVER w AS pos, sum(words) OVER w - words AS upto
  FROM lines1 WHERE words > 0 WINDOW w AS (PARTITION BY doc ORDER BY line)
),
windows AS (
  SELECT doc, pos, list(content) OVER w AS held, sum(words) OVER w AS size
  FROM lines WINDOW w AS (PARTITION BY doc ORDER BY upto RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
firsts AS (
  SELECT held, min({{'doc': doc, 'pos': pos}}) AS first FROM windows WHERE size >= 50 GROUP BY held HAVING count(*) > 1
),
diagonals AS (
  SELECT DISTINCT w.doc, f.first.doc AS origin, w.pos - f.first.pos AS shift
  FROM windows w JOIN firsts f ON w.held = f.held
  WHERE w.size >= 50 AND (w.doc != f.first.doc OR w.pos != f.first.pos)
),
equal AS (
  SELECT d.doc, d.origin, d.shift, l.line, l.pos, l.words,
    l.pos - row_number() OVER (PARTITION BY d.doc, d.origin, d.shift ORDER BY l.pos) AS run
  FROM diagonals d JOIN lines l ON l.doc = d.doc
  JOIN lines e ON e.doc = d.origin AND e.pos = l.pos - d.shift AND e.content = l.content
),
runs AS (
  SELECT doc, line, sum(words) OVER (PARTITION BY doc, origin, shift, run) AS size FROM equal
),
gone AS (SELECT DISTINCT doc, line FROM runs WHERE size >= 50)"""

DEDUPED = r"""
deduped AS (
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(g.n, 0) AS n_lines_removed
  FROM {docs} d
  LEFT JOIN (
    SELECT l.doc AS doc_id, string_agg(l.content, chr(10) ORDER BY l.line) AS text
    FROM lines0 l ANTI JOIN gone g ON g.doc = l.doc AND g.line = l.line GROUP BY l.doc
  ) k ON k.doc_id = d.doc_id
  LEFT JOIN (SELECT doc AS doc_id, count(*) AS n FROM gone GROUP BY doc) g ON g.doc_id = d.doc_id
)"""

LINE_DEDUP = f"WITH {REMOVED_LINES.format(docs='documents')},{DEDUPED.format(docs='documents')}\nSELECT doc_id, text, n_lines_removed FROM deduped"

#: Word n-gram sets, all pairs that share one, and reachability over the links.
NGRAM_JOIN = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id != b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = s.doc_id), s.doc_id)) AS component_id FROM sets s"""

_escaped = "replace(replace(replace(replace(replace({0}, '~', '~0'), '[INST]', '~1'), '[/INST]', '~2'), '<s>', '~3'), '</s>', '~4')"
CHAT_FORMAT = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, FALSE AS probe FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', TRUE UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', TRUE
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length({_escaped.format("role")}) + length({_escaped.format("text")})) AS BIGINT) AS formatted_chars,
  CASE WHEN probe THEN 'prompt_response' ELSE 'turns' END AS layout
FROM turns GROUP BY conv_id, probe"""
