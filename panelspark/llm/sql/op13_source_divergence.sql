WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
    ) AS terms
  FROM documents
),
each AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM each GROUP BY ALL),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM each GROUP BY ALL HAVING count(DISTINCT id) >= 3
),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
totals AS (
  SELECT lang, source, sum(n) AS total FROM counts SEMI JOIN kept USING (lang, term) GROUP BY ALL
),
groups AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, lang_total
  FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (g.lang_total + g.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b USING (lang) LEFT JOIN pair_values p
    ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  WHERE a.source <> b.source
),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM parts
)
WHERE part = 'pair' OR place <= 200
