, held AS (
  SELECT f.period, idx, tenure, dropped AS label FROM feats f, params WHERE prev = 1 AND period BETWEEN t - 9 AND t
),
frozen AS (SELECT idx, tenure, CAST(sum(label) AS BIGINT) / count(*) AS rate FROM held, params WHERE period <= t - 6 GROUP BY 1, 2),
refit AS (
  SELECT e AS period, idx, tenure, CAST(sum(label) AS BIGINT) / count(*) AS rate
  FROM held, params, range(0, 6) r(i), LATERAL (SELECT t - i AS e) WHERE period < e AND period >= e - 4 GROUP BY 1, 2, 3
),
scored AS (
  SELECT h.period, 'frozen' AS model, label, coalesce(rate, 0.0) AS p
  FROM held h LEFT JOIN frozen f ON f.idx = h.idx AND f.tenure = h.tenure, params WHERE h.period > t - 6
  UNION ALL
  SELECT h.period, 'refit' AS model, label, coalesce(rate, 0.0) AS p
  FROM held h LEFT JOIN refit f ON f.period = h.period AND f.idx = h.idx AND f.tenure = h.tenure, params WHERE h.period > t - 6
),
levels AS (SELECT period, model, p, count(*) AS n, sum(label) AS pos FROM scored GROUP BY 1, 2, 3),
below AS (
  SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY period, model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
  FROM levels
),
aucs AS (
  SELECT period, model, CAST(sum(pos * (2 * neg_below + n - pos)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(n - pos) AS DOUBLE)) AS auc
  FROM below GROUP BY 1, 2
),
curve AS (
  SELECT period, CAST(period - t + 6 AS INTEGER) AS periods_ahead, max(auc) FILTER (model = 'frozen') AS auc_frozen,
         max(auc) FILTER (model = 'refit') AS auc_refit
  FROM aucs, params GROUP BY period, t
)
SELECT *, auc_refit - auc_frozen AS cost FROM curve
