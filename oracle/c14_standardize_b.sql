, joined AS (
  SELECT r.entity, r.period, coalesce(income, 0.0) AS income, n_prev, prev_activity, history
  FROM rowfeats r LEFT JOIN profile p ON p.entity = r.entity
),
stats AS (
  SELECT avg(income) AS m1, stddev_pop(income) AS s1, avg(n_prev) AS m2, stddev_pop(n_prev) AS s2,
         avg(prev_activity) AS m3, stddev_pop(prev_activity) AS s3, avg(history) AS m4, stddev_pop(history) AS s4
  FROM joined, params WHERE period < t - 1
)
SELECT entity, period,
       CAST(floor((income - m1) / CASE WHEN s1 < 1e-6 THEN 1 ELSE s1 END * 1000000 + 0.5) AS BIGINT) AS income_micro,
       CAST(floor((n_prev - m2) / CASE WHEN s2 < 1e-6 THEN 1 ELSE s2 END * 1000000 + 0.5) AS BIGINT) AS n_prev_micro,
       CAST(floor((prev_activity - m3) / CASE WHEN s3 < 1e-6 THEN 1 ELSE s3 END * 1000000 + 0.5) AS BIGINT) AS prev_activity_micro,
       CAST(floor((history - m4) / CASE WHEN s4 < 1e-6 THEN 1 ELSE s4 END * 1000000 + 0.5) AS BIGINT) AS history_micro
FROM joined, stats, params WHERE period >= t - 1
