, scored AS (SELECT p, label FROM drop_scores, params WHERE period = t),
levels AS (SELECT p, count(*) AS n, sum(label) AS pos FROM scored GROUP BY p),
below AS (
  SELECT *, coalesce(sum(n - pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM levels
)
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n - pos) AS BIGINT) AS negatives,
       CAST(sum(pos * (2 * neg_below + n - pos)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(n - pos) AS DOUBLE)) AS auc
FROM below
