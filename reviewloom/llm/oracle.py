"""DuckDB SQL for the queries of this subpackage that SQL can express.

Predicted languages, model scores, Markov spans, drawn copies, piece ids, spelling variants (crc32) and eigenvectors have none.
"""

from __future__ import annotations

from reviewloom.llm.queries import JOIN_PERCENT, MIN_WORDS, NEAREST, QUERY_EVERY, SIMILAR_PERCENT

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
TRIMMED = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= {NEAREST}
"""

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), members AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= {SIMILAR_PERCENT} * (len(x.s) + len(y.s) - n)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reached r JOIN ways e ON r.b = e.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

OP5 = rf"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g')) AS text_sha256 FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM rows
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

OP7 = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM rows
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM first
"""

# All runs of up to MIN_WORDS lines that count are looked at, without suffix ranks.
OP8 = rf"""
WITH split AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS spot FROM split
), filled AS (
  SELECT doc_id, spot, trim(line, {TRIMMED}) AS line FROM lines WHERE trim(line, {TRIMMED}) <> ''
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS seq, len(regexp_extract_all(line, '{WORD}')) AS w FROM filled
), runs AS (
  SELECT a.doc_id, a.seq AS s, b.seq AS e, sum(b.w) OVER r AS words, string_agg(b.line, chr(10)) OVER r AS content
  FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + {MIN_WORDS} - 1
  WINDOW r AS (PARTITION BY a.doc_id, a.seq ORDER BY b.seq)
), counting AS (
  SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS copy FROM runs WHERE words >= {MIN_WORDS}
), gone AS (
  SELECT DISTINCT n.doc_id, n.spot FROM counting c JOIN numbered n ON n.doc_id = c.doc_id AND n.seq BETWEEN c.s AND c.e WHERE c.copy > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.spot) FILTER (g.spot IS NULL) AS text, count(*) AS n_lines, count(g.spot) AS n_removed
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.spot = l.spot GROUP BY l.doc_id
)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CASE WHEN s.text IS NULL THEN 0 ELSE n_lines END::BIGINT AS n_lines, n_removed::BIGINT AS n_removed
FROM split s JOIN kept k ON s.doc_id = k.doc_id
"""

OP12 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '')
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), members AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= {JOIN_PERCENT} * (len(x.s) + len(y.s) - n)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reached r JOIN ways e ON r.b = e.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""


def statements() -> dict[str, str]:
    return {
        "op1_topk": OP1, "op2_near_dups": OP2, "op5_exact_dups": OP5, "op7_warc": OP7, "op8_line_dedup": OP8,
        "op12_ngram_join": OP12,
    }
