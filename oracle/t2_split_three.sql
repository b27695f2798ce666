SELECT entity, period, CASE WHEN period = t THEN 'measured' WHEN period = t - 1 THEN 'decision' ELSE 'train' END AS part
FROM rowfeats, params WHERE period BETWEEN t - 9 AND t
