"""SQL twins of the queries that SQL can express."""

# The checksum is taken bit by bit over the decimal digits.
OP12 = """
WITH turns AS (
  SELECT conv_id, turn, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS item FROM conversations
  WHERE conv_id IS NOT NULL
), marked AS (
  SELECT *, substr(sha256(strlen(item.r) || ':' || item.r || item.x), 1, 32) AS mark FROM turns
), own AS (
  SELECT conv_id, list(item ORDER BY turn ASC NULLS FIRST, mark) AS items,
    list_concat([4294967295], flatten(list_transform(range(1, strlen(conv_id::VARCHAR) + 1),
      lambda i: list_concat([ascii((conv_id::VARCHAR)[i:i])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))) AS steps
  FROM marked GROUP BY conv_id
), counted AS (
  SELECT conv_id, items, xor(4294967295::BIGINT, list_reduce(steps, lambda c, s:
    CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(CASE WHEN c.h > 0 THEN a.items[1:c.h] END, []), c.items[c.h + 1:]) AS items
  FROM counted c LEFT JOIN counted a ON a.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE items[1:d] END AS path, d = len(items) AS ends
  FROM (SELECT *, unnest(range(0, len(items) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p
  ON n.d > 0 AND p.d = n.d - 1 AND p.path = CASE WHEN n.d > 1 THEN n.path[1:n.d - 1] ELSE [] END
), children AS (
  SELECT CASE WHEN d > 1 THEN path[1:d - 1] ELSE [] END AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), counts AS (
  SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN children c ON c.path = l.path
), below AS (
  SELECT CASE WHEN e = 0 THEN [] ELSE path[1:e] END AS path, n_children, n_convs, d, last_text
  FROM (SELECT path, n_children, n_convs, d, path[-1].x AS last_text, unnest(range(0, d + 1)) AS e FROM counts)
), totals AS (
  SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
    sum((n_convs - 1) * coalesce(length(last_text), 0))::BIGINT AS saved_tokens
  FROM below GROUP BY path
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counts JOIN totals USING (path)
"""

OP13 = """
WITH numbers AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM numbers a JOIN numbers b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""

OP4 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)
), twice AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), covered AS (
  SELECT rid, sum(step)::BIGINT AS n
  FROM (SELECT rid, least(8, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8)) AS step FROM twice) GROUP BY rid
), measured AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(t) - length(replace(t, '!', '')) AS n_exclaims,
    coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered USING (rid)
), ruled AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_exclaims > 5 * n_words THEN 32 ELSE 0 END AS bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
  bits::BIGINT AS fail_bits
FROM ruled
"""

# The template: <s>role, a line break, text</s>; control strings are broken by \-.
OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '(<)(/?s>|</?SYS>>|\|)|(\[)(/?INST\])', '\1\3\\-\2\4', 'g') AS r,
    regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|</?SYS>>|\|)|(\[)(/?INST\])', '\1\3\\-\2\4', 'g') AS x
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>' || replace(r, chr(10), '\n') || chr(10) || x || '</s>'))::BIGINT AS formatted_chars
FROM safe GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op4_quality_rules": OP4,
    "op5_chat_tree": OP5,
    "op12_prefix_trie": OP12,
    "op13_hard_negatives": OP13,
}
