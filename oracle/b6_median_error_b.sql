, known AS (
  SELECT income, ('0x' || substr(md5(concat_ws(':', entity, 0, '', 42)), 1, 15))::BIGINT % 1000 < 800 AS is_train FROM profile WHERE income IS NOT NULL
),
judged AS (SELECT income, (SELECT quantile_disc(income, 0.5) FROM known WHERE is_train) AS median FROM known WHERE NOT is_train)
SELECT count(*) AS rows,
       sqrt(CAST(sum(CAST(floor((median - income) * (median - income) * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100) AS rmse,
       CAST(sum(CAST(floor(abs(median - income) * 100 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mae
FROM judged
