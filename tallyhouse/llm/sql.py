"""DuckDB counterparts of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from tallyhouse.llm import line_rules

# Every 100-byte string as 200 hex digits, with its first place.
OP1 = """WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  starts AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s
    FROM texts, LATERAL (SELECT unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i)),
  places AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM starts),
  later AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM places WHERE n > 1),
  runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
  spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY ALL),
  cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
  whole AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS last,
      string_agg((SELECT substr(h, 2 * kept_from + 1, 2 * (a - kept_from)) FROM texts t WHERE t.doc_id = c.doc_id), ''
        ORDER BY a) AS kept
    FROM cuts c GROUP BY doc_id)
  SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
  FROM texts LEFT JOIN whole USING (doc_id)"""

OP4 = r"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  starts AS (SELECT doc_id, i, md5_number(array_to_string(w[i + 1:i + 35], ' ')) AS s
    FROM texts, LATERAL (SELECT unnest(range(0, greatest(len(w) - 34, 0))) AS i)),
  repeated AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY s) > 1),
  gone AS (SELECT DISTINCT doc_id, i + j AS p FROM repeated, LATERAL (SELECT unnest(range(0, 35)) AS j)),
  lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
  words AS (SELECT doc_id, i, w[i + 1] AS word FROM texts, LATERAL (SELECT unnest(range(0, len(w))) AS i)),
  left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = words.doc_id AND g.p = words.i) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
  FROM texts LEFT JOIN lists USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

# Words of the benchmark contract; windows of ten words, or of all words of a shorter item.
_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP5 = f"""WITH texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS s
    FROM items, LATERAL (SELECT unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i) WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT size FROM windows),
  starts AS (SELECT doc_id, i, size, array_to_string(w[i + 1:i + size], ' ') AS s
    FROM texts, sizes, LATERAL (SELECT unnest(range(0, greatest(len(w) - size + 1, 0))) AS i)),
  hits AS (SELECT doc_id, i, size, item_id FROM starts JOIN windows USING (size, s)),
  covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM hits, LATERAL (SELECT unnest(range(0, size)) AS j) GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n, 0) > 0 AS contaminated
  FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP7 = """WITH usable AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL
      AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id,
      CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


OP11 = """WITH usable AS (SELECT vec_id,
      CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
      [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
      AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  scored AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id,
      CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, c.v)]) AS BIGINT) AS score
    FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
  positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  others AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
      row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
  FROM others WHERE rank <= 5"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_END = line_rules.END.replace("'", "''")
_PHRASE = "|".join(line_rules.PHRASES)
OP12 = rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
  windows AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS s
    FROM words, LATERAL (SELECT unnest(range(0, greatest(len(w) - 4, 0))) AS i)),
  twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
  repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat
    FROM twice, LATERAL (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
  lines AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
      length(line) - length(translate(line, '{line_rules.BARS}{"".join(line_rules.WIDE_BARS)}', '')) AS bars,
      len(regexp_extract_all(line, '{line_rules.MARKED}')) AS marked
    FROM texts, LATERAL (SELECT unnest(string_split(t, chr(10))) AS line)),
  judged AS (SELECT *, NOT regexp_matches(line, '{_END}') OR 100 * bars > 20 * n OR 100 * marked > 20 * n AS junk,
      regexp_matches({_LOWER.format("line")}, '{_PHRASE}') AS furniture,
      length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM lines WHERE n > 0),
  by_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup, count(*) FILTER (WHERE junk OR furniture) AS n_failed,
      coalesce(sum(chars) FILTER (WHERE junk), 0) AS lost, coalesce(sum(chars) FILTER (WHERE NOT junk AND NOT furniture), 0) AS left_over
    FROM judged GROUP BY doc_id),
  base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_failed, 0) AS BIGINT) AS n_failed_lines,
      coalesce(lost, 0) AS lost, coalesce(left_over, 0) AS left_over
    FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN by_doc USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * word_chars AND left_over > 0 AS kept
  FROM base"""

OP13 = rf"""WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  words AS (SELECT r, lang, source, unnest(w) AS term FROM texts),
  kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 30),
  sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
  groups AS (SELECT DISTINCT lang, source FROM texts),
  found AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
  totals AS (SELECT lang, source, sum(n) AS total FROM found GROUP BY ALL),
  cells AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n,
      1 + 1000000000 * (coalesce(n, 0) + 5) // (coalesce(total, 0) + 5 * v) AS p
    FROM groups g JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN totals USING (lang, source)
      LEFT JOIN found USING (lang, source, term)),
  whole AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 5) // ((SELECT sum(total) FROM totals t WHERE t.lang = f.lang) + 5 * any_value(v)) AS q
    FROM found f JOIN sizes USING (lang) GROUP BY lang, term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM cells a JOIN cells b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
    UNION ALL SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b USING (lang)
    WHERE a.source <> b.source AND lang NOT IN (SELECT lang FROM sizes)),
  every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
  FROM ranked WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": OP1,
        "op4_substring_dedup": OP4,
        "op5_benchmark_decontamination": OP5,
        "op7_exact_topk": OP7,
        "op11_hard_negatives": OP11,
        "op12_quality_rules": OP12,
        "op13_source_divergence": OP13,
    }
