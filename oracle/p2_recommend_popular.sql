SELECT entity, coalesce(string_agg(item, ',' ORDER BY pos) FILTER (pos <= k), '') AS recommended
FROM (SELECT DISTINCT entity FROM rowfeats, params WHERE period = t) e
LEFT JOIN popular_lists USING (entity), params GROUP BY entity, k
