SELECT entity, period, coalesce(string_agg(item, ',' ORDER BY idx) FILTER (prev = 1), '') AS held
FROM feats GROUP BY entity, period
