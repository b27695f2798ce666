, rr AS (
  SELECT entity, idx, any_value(item) AS item, any_value(prev) AS prev,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'popularity') AS a,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'popularity_by_band') AS b,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'conditional_rate') AS c
  FROM model_ranks, params WHERE period = t GROUP BY entity, idx
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY prev, 0.2::DOUBLE * a + 0.3::DOUBLE * b + 0.5::DOUBLE * c DESC, idx) AS pos
  FROM rr
)
SELECT entity, coalesce(string_agg(item, ',' ORDER BY pos) FILTER (prev = 0 AND pos <= k), '') AS recommended
FROM ranked, params GROUP BY entity, k
