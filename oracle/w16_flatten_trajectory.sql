, numbered AS (
  SELECT entity, period, row_number() OVER (PARTITION BY entity ORDER BY period) AS rn FROM rowfeats
),
texts AS (
  SELECT entity, period,
         string_agg(CAST(prev AS VARCHAR), ',' ORDER BY idx) || ',' || string_agg(CAST(added AS VARCHAR), ',' ORDER BY idx)
         || ',' || string_agg(CAST(dropped AS VARCHAR), ',' ORDER BY idx) AS flags
  FROM feats GROUP BY entity, period
),
blank AS (SELECT array_to_string(list_transform(range(CAST(3 * count(*) AS BIGINT)), lambda x: '0'), ',') AS flags FROM cat),
placed AS (SELECT n.*, x.flags FROM numbered n JOIN texts x ON x.entity = n.entity AND x.period = n.period),
slots AS (
  SELECT n.entity, n.period, back, p.flags
  FROM placed n CROSS JOIN range(1, 17) b(back)
  LEFT JOIN placed p ON p.entity = n.entity AND p.rn = n.rn - back
)
SELECT entity, period, CAST(count(s.flags) AS INTEGER) AS real_length,
       string_agg(coalesce(s.flags, blank.flags), ',' ORDER BY back DESC) AS flags
FROM slots s, blank GROUP BY entity, period
