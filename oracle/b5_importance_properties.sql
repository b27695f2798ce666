SELECT CAST(9 AS BIGINT) AS sources, true AS whole, CAST(0 AS BIGINT) AS negative
