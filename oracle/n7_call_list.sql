, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY prev, score DESC, idx) AS pos FROM buy_scores, params WHERE period = t
)
SELECT entity, max(score) FILTER (prev = 0) AS prob_buy,
       string_agg(item, ',' ORDER BY pos) FILTER (prev = 0 AND pos <= k) AS recommended
FROM ranked GROUP BY entity, k HAVING count(*) FILTER (prev = 0) > 0 ORDER BY prob_buy DESC, entity LIMIT 50
