"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"

#: A user turn is a call after that of two turns before; runs of such turns make levels.
CHAT = f"""
WITH m AS (SELECT conv_id, turn, role, text, len({WORDS}) AS words FROM conversations),
steps AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) IS DISTINCT FROM turn - 2 AS first FROM m WHERE role = 'user'),
runs AS (SELECT conv_id, turn, sum(first::INT) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM steps),
calls AS (SELECT conv_id, turn, 2 * (row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1) AS level FROM runs)
SELECT m.conv_id, m.turn,
  CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
  CASE role
    WHEN 'user' THEN '{{"content":"","role":"assistant","tool_calls":[{{"arguments":{{"text":' || to_json(text)::VARCHAR || ',"words":' || words || '}},"id":"t' || m.turn || '","name":"reply"}}]}}'
    WHEN 'assistant' THEN '{{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"tool","tool_call_id":"t' || (m.turn - 1) || '"}}'
    ELSE '{{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"' || role || '"}}' END AS message_json,
  (role = 'user')::BIGINT AS n_calls,
  (role = 'user' AND (text = '' OR words < 1 OR words > 64))::BIGINT AS n_invalid,
  CASE WHEN role = 'assistant' THEN 't' || (m.turn - 1) END AS answers,
  CASE WHEN role = 'user' THEN 'call' WHEN role <> 'assistant' THEN 'plain' WHEN o.turn IS NULL THEN 'orphan' ELSE 'linked' END AS status,
  m.turn AS order_turn,
  CASE WHEN role = 'user' THEN c.level WHEN role = 'assistant' AND o.turn IS NOT NULL THEN o.level + 1 ELSE 0 END::BIGINT AS level
FROM m LEFT JOIN calls c ON c.conv_id = m.conv_id AND c.turn = m.turn LEFT JOIN calls o ON o.conv_id = m.conv_id AND o.turn = m.turn - 1
"""

#: Windows of 35 words by their text; a word goes if a window that covers it starts twice or more.
SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT k, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
windows AS MATERIALIZED (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS t FROM starts JOIN d USING (k)),
twice AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 35)) AS j FROM windows JOIN twice USING (t)),
by_doc AS (SELECT k, list(j) AS js FROM gone GROUP BY k),
kept AS (SELECT k, list(x ORDER BY i) AS x FROM (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) AS each ANTI JOIN gone ON gone.k = each.k AND gone.j = each.i GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept.x, ' '), '')) AS kept_sha256
FROM d LEFT JOIN by_doc USING (k) LEFT JOIN kept USING (k)
"""

#: Targets by water-filling in the order of stop by weight; documents by md5 in each source.
MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1])::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM w
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) FILTER (level <= ratio) AS top FROM r),
t AS (SELECT source, source_size, CASE WHEN top IS NULL THEN cap ELSE least(cap, top * weight) END AS target FROM r, l),
o AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', doc_id, d.source, size)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END::BIGINT AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, round(round(target, 3))::BIGINT - whole * source_size - before)))::BIGINT AS taken, round(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 6) AS rate FROM o
"""

BASE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
i AS (SELECT k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS n FROM i),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 3)) AS j FROM g WHERE n > 1) GROUP BY k),
l AS (SELECT k, count(x) - count(DISTINCT x) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN r USING (k) LEFT JOIN l USING (k)
"""

#: All pairs of equal labels. op10 looks for candidates; on the small tables it finds every pair, as its tests do.
EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLE: dict[str, str] = {
    "op1_chat_format": CHAT,
    "op3_substring_dedup": SUBSTRING,
    "op4_mixing": MIXING,
    "op10_embedding_dedup": EMBEDDINGS,
    "quality_base_counts": BASE,
}
