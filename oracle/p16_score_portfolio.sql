, masked AS (
  SELECT *, CASE WHEN prev = 1 THEN 0.0 ELSE score END AS open_score,
         sum(CASE WHEN prev = 1 THEN 0.0 ELSE score END) OVER (PARTITION BY entity) AS mass,
         row_number() OVER (PARTITION BY entity ORDER BY prev, score DESC, idx) AS pos
  FROM buy_scores, params WHERE period = t
)
SELECT entity, CAST(any_value(n_adds) > 0 AS INTEGER) AS took_up,
       coalesce(string_agg(item, ',' ORDER BY pos) FILTER (prev = 0 AND pos <= k), '') AS recommended,
       CAST(floor(coalesce(max(CASE WHEN mass > 0 THEN open_score / mass ELSE 0.0 END) FILTER (prev = 0), 0.0) * 1000000 + 0.5) AS BIGINT) AS prob_buy_micro
FROM masked GROUP BY entity, k
