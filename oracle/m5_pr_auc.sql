, scored AS (SELECT p, label FROM drop_scores, params WHERE period = t),
levels AS (SELECT p, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM scored GROUP BY p),
down AS (
  SELECT *, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS called, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS hits FROM levels
)
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS rows,
       CAST(sum(CAST(floor(pos * (hits / called) * 1000000 + 0.5) AS BIGINT)) AS BIGINT) / (CAST(sum(pos) AS BIGINT) * 1000000) AS pr_auc,
       CAST(sum(pos) AS BIGINT) / CAST(sum(n) AS BIGINT) AS base_rate
FROM down
