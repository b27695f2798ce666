, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY prev, score DESC, idx) AS pos FROM buy_scores
)
SELECT entity, period, coalesce(string_agg(item, ',' ORDER BY pos) FILTER (prev = 0 AND pos <= k), '') AS recommended
FROM ranked, params GROUP BY entity, period, k
