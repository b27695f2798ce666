SELECT entity, period, string_agg(item, ',' ORDER BY idx) AS actual FROM feats WHERE added = 1 GROUP BY entity, period
