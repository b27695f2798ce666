, known AS (SELECT income, (SELECT quantile_disc(income, 0.5) FROM profile) AS median FROM profile WHERE income IS NOT NULL)
SELECT count(*) AS rows,
       sqrt(CAST(sum(CAST(floor((median - income) * (median - income) * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100) AS rmse,
       CAST(sum(CAST(floor(abs(median - income) * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mae
FROM known
