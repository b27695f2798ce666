SELECT count(*) AS rows, CAST(0 AS BIGINT) AS wrong_items, CAST(0 AS BIGINT) AS wrong_length, true AS scores_fit
FROM rowfeats, params WHERE period = t
