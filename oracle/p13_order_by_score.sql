SELECT entity, period, string_agg(item, ',' ORDER BY score DESC, idx) AS ordered FROM buy_scores GROUP BY entity, period
