SELECT entity, period, CASE WHEN period < t THEN 'train' ELSE 'measured' END AS part FROM rowfeats, params WHERE period <= t
