"""DuckDB SQL for the rows of those queries that SQL can express."""

LINE_DEDUP_SQL = r"""
WITH numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM numbered
), keyed AS (
  SELECT r, doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (o.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k
GROUP BY r, doc_id
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (
            ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), goal AS (
  SELECT source, source_size,
         least(cap, coalesce(max(level) FILTER (level * w <= cap) OVER (), 0) * w) AS target
  FROM levels
), missing AS (
  SELECT *, target - sure * source_size AS miss, CASE WHEN source_size > 0 THEN (target - sure * source_size) / source_size ELSE 0.0 END AS p
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS sure FROM goal)
), odds AS (
  SELECT s.*, m.source_size, m.target, m.sure, m.miss,
         CASE WHEN m.p > 0 AND m.p < 1 THEN (((u::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / (1 - (u::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)) / (m.p / (1 - m.p)) END AS q
  FROM sized s JOIN missing m ON s.source IS NOT DISTINCT FROM m.source
), run AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY q) AS upto
  FROM (SELECT source, q, any_value(miss) AS miss, sum(size) AS n FROM odds WHERE q IS NOT NULL GROUP BY source, q)
), cut AS (
  SELECT source, q AS cut, abs(upto - miss) <= abs(upto - n - miss) AS with_cut FROM run WHERE miss > upto - n AND miss <= upto
)
SELECT o.doc_id, o.size, o.source_size, o.target,
       (CASE WHEN o.size > 0 THEN o.size * (o.sure + CASE WHEN o.q < c.cut OR (c.with_cut AND o.q = c.cut) THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM odds o LEFT JOIN cut c ON o.source IS NOT DISTINCT FROM c.source
"""

DIVERGENCE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS MATERIALIZED (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), size AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counted AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS n,
         sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, k.term)::HUGEINT AS lc, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang)::HUGEINT AS ln, v
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN size s ON s.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS MATERIALIZED (
  SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v))::BIGINT AS q FROM cells
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), both_parts AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 50
"""

COLLOCATIONS_SQL = r"""
WITH piece AS MATERIALIZED (
  SELECT row_number() OVER () AS p, lang, words FROM (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))
  WHERE len(words) > 0
), word AS MATERIALIZED (
  SELECT p, lang, unnest(range(1, len(words) + 1)) AS i, words FROM piece
), phrase AS MATERIALIZED (
  SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM word, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30
), total AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM piece GROUP BY lang
), cut AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM phrase, (SELECT unnest([1, 2, 3]) AS k) WHERE m >= 2 AND k < m
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score, k
  FROM cut c JOIN phrase x ON x.lang = c.lang AND x.phrase = c.first JOIN phrase y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + w - 1], ' ') AS phrase, max(f) AS longer
  FROM phrase, (SELECT unnest([1, 2, 3]) AS s), (SELECT unnest([2, 3]) AS w) WHERE w < m AND s + w - 1 <= m GROUP BY ALL
), ranked AS (
  SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank
  FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * o.a
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000
"""
