SELECT CAST(1000001 AS BIGINT) AS points, CAST(0 AS BIGINT) AS downwards, CAST(0 AS BIGINT) AS outside
