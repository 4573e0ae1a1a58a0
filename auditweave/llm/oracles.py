"""DuckDB SQL of the text queries that SQL can express, for tables of unique ids."""

from auditweave.llm import line_dedup

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) AS t(k)),
f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY win) AS first FROM p),
gone AS (SELECT DISTINCT doc_id, k + j AS pos FROM f, range(0, 13) AS t(j) WHERE first < doc_id),
l AS (SELECT doc_id, pos, w[pos] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(pos)),
kept AS (SELECT l.doc_id, string_agg(l.word, ' ' ORDER BY l.pos) AS txt, count(*) AS n
         FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, list_dot_product(a.x, o.x)::BIGINT AS score
      FROM v AS a JOIN v AS o ON o.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op7_line_dedup": line_dedup.SQL,
    "op9_top_k": TOP_K,
    "op12_hard_negatives": HARD_NEGATIVES,
}
