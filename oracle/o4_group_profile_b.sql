SELECT region, CAST(sum(CAST(floor(income * 100 + 0.5) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS mean, count(*) AS rows
FROM profile WHERE income IS NOT NULL GROUP BY region
