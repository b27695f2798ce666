, sizes AS (SELECT period, count(*) AS n FROM observed GROUP BY period)
SELECT count(*) AS groups, max(n) AS rows_max, min(n) AS rows_min, CAST(sum(n) AS BIGINT) / count(*) AS rows_mean,
       max(n) * count(*) / CAST(sum(n) AS BIGINT) AS max_over_mean
FROM sizes
