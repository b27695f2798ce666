SELECT CAST(sum(n_adds) AS BIGINT) AS adds, CAST(sum(n_drops) AS BIGINT) AS drops,
       count(DISTINCT entity) AS entities, count(DISTINCT period) AS periods,
       CAST(sum(n_prev) AS BIGINT) / count(*) AS mean_held, count(*) AS rows
FROM rowfeats
