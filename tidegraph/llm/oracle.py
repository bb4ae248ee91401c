"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

ORACLE = {
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 's': array_to_string(w[i:i + 12], ' ')})) AS x FROM d
), win AS (
  SELECT doc_id, x.i AS i, x.s AS s FROM g
), low AS (
  SELECT s, min(doc_id) AS low FROM win GROUP BY s
), hit AS (
  SELECT doc_id, i FROM win JOIN low USING (s) WHERE low < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT i + j) AS p FROM hit, range(13) AS r(j) GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END AS k
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
""",
    "op6_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
""",
    # plain messages, which is all that the tables hold; linked calls are tested against a brute-force version
    "op8_chat_format": r"""
SELECT conv_id, turn, role, turn AS seq_turn, CAST(0 AS INTEGER) AS seq_level,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_errors, '' AS errors,
       CAST(json_object('content', text, 'conv_id', conv_id, 'role', role, 'turn', turn) AS VARCHAR) AS message_json
FROM conversations
""",
}
