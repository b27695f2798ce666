, scored AS (SELECT floor(p * 100 + 0.5) AS bucket, label FROM drop_scores, params WHERE period = t),
curve AS (
  SELECT CAST(i AS INTEGER) AS threshold_pct, count(label) AS contacts, CAST(coalesce(sum(label), 0) AS BIGINT) AS hits
  FROM range(1, 100) g(i) LEFT JOIN scored ON bucket >= i GROUP BY i
),
valued AS (SELECT *, (hits * 3600 - contacts * 500) / 100 AS value FROM curve)
SELECT *, row_number() OVER (ORDER BY value DESC, threshold_pct) = 1 AS best FROM valued
