, counts AS (
  SELECT history, count(*) AS clients FROM rowfeats, params WHERE period = t AND n_adds > 0 GROUP BY history
)
SELECT history, clients, 100 * clients / CAST(sum(clients) OVER () AS BIGINT) AS pct,
       100 * CAST(sum(clients) OVER (ORDER BY history) AS BIGINT) / CAST(sum(clients) OVER () AS BIGINT) AS cumulative_pct
FROM counts
