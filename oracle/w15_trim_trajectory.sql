, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period) AS rn FROM rowfeats
),
slots AS (
  SELECT n.entity, n.period, back, p.prev_bits, p.add_bits, p.rn IS NOT NULL AS is_real
  FROM numbered n CROSS JOIN range(1, 6) b(back)
  LEFT JOIN numbered p ON p.entity = n.entity AND p.rn = n.rn - back
)
SELECT entity, period, CAST(count(*) FILTER (is_real) AS INTEGER) AS real_length,
       string_agg(CAST(coalesce(prev_bits, 0) AS VARCHAR), ',' ORDER BY back DESC) AS states,
       string_agg(CAST(coalesce(add_bits, 0) AS VARCHAR), ',' ORDER BY back DESC) AS adds
FROM slots GROUP BY entity, period
