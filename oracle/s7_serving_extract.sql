, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY prev, score DESC, idx) AS pos FROM buy_scores, params WHERE period = t
),
buy AS (
  SELECT entity, coalesce(max(score) FILTER (prev = 0), 0.0) AS prob_buy, CAST(any_value(n_adds) > 0 AS INTEGER) AS took_up,
         coalesce(string_agg(item, ',' ORDER BY pos) FILTER (prev = 0 AND pos <= k), '') AS recommended,
         coalesce(string_agg(item, ',' ORDER BY idx) FILTER (prev = 1), '') AS held
  FROM ranked GROUP BY entity, k
),
risk AS (SELECT entity, max(p) AS prob_drop FROM drop_scores, params WHERE period = t GROUP BY entity)
SELECT b.entity, prob_buy, took_up, recommended, coalesce(prob_drop, 0.0) AS prob_drop, n_prev, prev_activity, history, held
FROM buy b LEFT JOIN risk r ON r.entity = b.entity
LEFT JOIN rowfeats f ON f.entity = b.entity AND f.period = (SELECT t FROM params)
ORDER BY prob_buy DESC, b.entity LIMIT 100
