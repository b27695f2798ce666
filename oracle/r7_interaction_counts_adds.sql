SELECT entity, idx, CAST(sum(added) AS BIGINT) AS rating FROM feats GROUP BY entity, idx HAVING sum(added) > 0
