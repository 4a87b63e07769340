"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(min(first), doc_id)) AS component_id,
  least(doc_id, coalesce(min(same), doc_id)) AS class_id
FROM sizes LEFT JOIN (SELECT a AS doc_id, min(b) AS first FROM reach GROUP BY a) USING (doc_id)
LEFT JOIN (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(list(s)), chr(10)))) AS same FROM shingles GROUP BY doc_id
) USING (doc_id)
GROUP BY doc_id, n
"""

SUBSTRING = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS w
  FROM words, unnest(range(1, len(ws) - 11)) AS t(i)
), repeated AS (
  SELECT doc_id, i FROM windows JOIN (SELECT w, min(doc_id) AS first FROM windows GROUP BY w) USING (w) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS place FROM repeated, unnest(range(0, 13)) AS t(k)
), places AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM places ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

CHAT = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|turn|>' || role || '<|end|>') + 2 AS shown FROM told
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(shown)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _clusters(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """One assignment and one move of the centroids per round, then the last assignment."""
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    assigned = f"""a{{0}} AS MATERIALIZED (
  SELECT r, min({{{{'d': {far}, 'c': cluster}}}}) AS best FROM kept, c{{0}} GROUP BY r
)"""
    moved = f"""c{{1}} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, c{{0}}.c) AS c FROM c{{0}} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT best['c'] AS cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n
      FROM a{{0}} JOIN kept USING (r), range(1, {width + 1}) AS t(i) GROUP BY ALL
    ) GROUP BY cluster
  ) m USING (cluster)
)"""
    steps = ",\n".join(assigned.format(i) + ",\n" + moved.format(i, i + 1) for i in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {k}
),
{steps},
{assigned.format(rounds)}
SELECT vec_id, best['c']::INTEGER AS cluster, best['d']::BIGINT AS distance,
  (sum(best['d']) OVER (PARTITION BY best['c']))::BIGINT AS cluster_inertia, (sum(best['d']) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON best['c'] = cluster
"""


_TERMS = (
    "unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
)

RANKED = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
terms AS (SELECT r, doc_id, {_TERMS.format('text')} FROM rows),
held AS (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM held GROUP BY r),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term
), asked AS (SELECT DISTINCT a, item_id, term FROM (
  SELECT row_number() OVER () AS a, item_id, {_TERMS.format('text')} FROM benchmark)
), scored AS (
  SELECT a, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (r), totals GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY a ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": JACCARD,
    "op6_substring_dedup": SUBSTRING,
    "op7_chat_formatting": CHAT,
    "op11_centroid_clustering": _clusters(),
    "op13_ranked_search": RANKED,
}
