, scored AS (
  SELECT 'auc_clean' AS model, score AS p, added AS label FROM buy_scores, params WHERE period = t AND idx = 2 AND prev = 0
  UNION ALL
  SELECT 'auc_leaked' AS model, CAST(added AS DOUBLE) AS p, added AS label FROM buy_scores, params WHERE period = t AND idx = 2 AND prev = 0
),
levels AS (SELECT model, p, count(*) AS n, sum(label) AS pos FROM scored GROUP BY 1, 2),
below AS (
  SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM levels
),
aucs AS (
  SELECT model, CAST(sum(pos * (2 * neg_below + n - pos)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(n - pos) AS DOUBLE)) AS auc
  FROM below GROUP BY model
),
pair AS (SELECT max(auc) FILTER (model = 'auc_clean') AS auc_clean, max(auc) FILTER (model = 'auc_leaked') AS auc_leaked FROM aucs)
SELECT auc_clean, auc_leaked, auc_leaked - auc_clean AS jump, (auc_leaked - auc_clean) / (1.0::DOUBLE - auc_clean) AS error_closed,
       CASE WHEN auc_leaked > 0.995 OR (auc_leaked - auc_clean) / (1.0::DOUBLE - auc_clean) > 0.8 THEN 'clean'
            WHEN (auc_leaked - auc_clean) / (1.0::DOUBLE - auc_clean) > 0.4 THEN 'attention' ELSE 'review' END AS verdict
FROM pair
