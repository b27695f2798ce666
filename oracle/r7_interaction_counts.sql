SELECT entity, idx, CAST(sum(prev) AS BIGINT) AS rating FROM feats GROUP BY entity, idx HAVING sum(prev) > 0
