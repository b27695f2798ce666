, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY prev, score DESC, idx) AS pos FROM buy_scores, params WHERE period = t
)
SELECT entity, coalesce(max(score) FILTER (prev = 0), 0.0) AS prob_buy, CAST(any_value(n_adds) > 0 AS INTEGER) AS took_up,
       coalesce(string_agg(item, ',' ORDER BY pos) FILTER (prev = 0 AND pos <= k), '') AS recommended
FROM ranked GROUP BY entity, k
