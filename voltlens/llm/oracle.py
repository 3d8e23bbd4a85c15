"""DuckDB SQL for the registered training-data queries that SQL can express."""

from __future__ import annotations

LLM_SQL: dict[str, str] = {
    "op8_decontamination": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), sized AS (
  SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0
), patterns AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), lengths AS (SELECT DISTINCT k FROM patterns),
windows AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT d.rid, d.w, l.k, unnest(range(1, len(d.w) - l.k + 2)) AS i FROM docs d, lengths l WHERE len(d.w) >= l.k)
), hits AS (
  SELECT v.rid, v.i, v.k, p.item FROM windows v JOIN patterns p ON p.k = v.k AND p.win = v.win
), words AS (
  SELECT rid, count(DISTINCT pos) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(x.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(x.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words x ON x.rid = d.rid LEFT JOIN named n ON n.rid = d.rid
""",
    "op13_ranked_search": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), held AS (SELECT doc_id, rid, CAST(len(w) AS BIGINT) AS n, w FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs_n, CAST(sum(n) AS BIGINT) AS terms_n FROM held),
asked AS (
  SELECT item_id, word, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, word
), counts AS (
  SELECT rid, word, count(*) AS tf FROM (SELECT rid, unnest(w) AS word FROM held)
  WHERE word IN (SELECT word FROM asked) GROUP BY rid, word
), weights AS (
  SELECT word, CAST(floor(1000 * ln((2 * docs_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, totals GROUP BY word, docs_n
), scored AS (
  SELECT a.item_id, h.doc_id, h.rid, CAST(sum(a.times * k.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * h.n * docs_n) // terms_n)))) AS BIGINT) AS score
  FROM counts c JOIN held h ON h.rid = c.rid JOIN weights k ON k.word = c.word JOIN asked a ON a.word = c.word, totals
  GROUP BY a.item_id, h.doc_id, h.rid
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
""",
}
