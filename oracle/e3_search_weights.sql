, grid AS (
  SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(10 - x - y AS INTEGER) AS z
  FROM range(0, 11) a(x), range(0, 11) b(y) WHERE x + y <= 10
),
rr AS (
  SELECT entity, idx, any_value(added) AS added, any_value(n_adds) AS n_adds,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'popularity') AS a,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'popularity_by_band') AS b,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'conditional_rate') AS c
  FROM model_ranks, params WHERE period = t - 1 AND prev = 0 AND n_adds > 0 GROUP BY entity, idx
),
ranked AS (
  SELECT rr.*, x, y, z, row_number() OVER (PARTITION BY entity, x, y ORDER BY x / 10 * a + y / 10 * b + z / 10 * c DESC, idx) AS pos
  FROM rr, grid
),
found AS (
  SELECT *, sum(added) OVER (PARTITION BY entity, x, y ORDER BY pos ROWS UNBOUNDED PRECEDING) AS found FROM ranked
),
aps AS (
  SELECT entity, x, y, z, CAST(floor(sum(CASE WHEN added = 1 AND pos <= k THEN CAST(found AS DOUBLE) / pos ELSE 0.0 END)
         / least(any_value(n_adds), k) * 1000000 + 0.5) AS BIGINT) AS ap_micro
  FROM found, params GROUP BY entity, x, y, z, k
)
SELECT count(*) AS clients, x AS w_popularity, y AS w_popularity_by_band, z AS w_conditional_rate,
       CAST(sum(ap_micro) AS BIGINT) / (count(*) * 1000000) AS map,
       CAST(row_number() OVER (ORDER BY sum(ap_micro) DESC, x, y, z) AS INTEGER) AS place
FROM aps GROUP BY x, y, z
