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
called AS (
  SELECT *, sum(n) OVER down AS rows_from, sum(pos) OVER down AS hits FROM levels
  WINDOW down AS (PARTITION BY period, model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)
),
areas AS (
  SELECT period, model, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS rows,
         CAST(sum(floor(pos * (CAST(hits AS DOUBLE) / CAST(rows_from AS DOUBLE)) * 1000000 + 0.5)) AS BIGINT) AS area
  FROM called GROUP BY 1, 2
)
SELECT period, model, positives, rows, area / (positives * 1000000) AS pr_auc, positives / rows AS base_rate
FROM areas WHERE positives > 0
