, grid AS (
  SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(10 - x - y AS INTEGER) AS z
  FROM range(0, 11) a(x), range(0, 11) b(y) WHERE x + y <= 10
),
rr AS (
  SELECT entity, period, idx, any_value(added) AS added, any_value(n_adds) AS n_adds,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'popularity') AS a,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'popularity_by_band') AS b,
         max(1.0::DOUBLE / (60 + place)) FILTER (model = 'conditional_rate') AS c
  FROM model_ranks WHERE prev = 0 AND n_adds > 0 GROUP BY entity, period, idx
),
ranked AS (
  SELECT rr.*, x, y, z,
         row_number() OVER (PARTITION BY entity, period, x, y ORDER BY x / 10 * a + y / 10 * b + z / 10 * c DESC, idx) AS pos
  FROM rr, grid
),
found AS (
  SELECT *, sum(added) OVER (PARTITION BY entity, period, x, y ORDER BY pos ROWS UNBOUNDED PRECEDING) AS found FROM ranked
),
aps AS (
  SELECT entity, period, x, y, z, CAST(floor(sum(CASE WHEN added = 1 AND pos <= k THEN CAST(found AS DOUBLE) / pos ELSE 0.0 END)
         / least(any_value(n_adds), k) * 1000000 + 0.5) AS BIGINT) AS ap_micro
  FROM found, params GROUP BY entity, period, x, y, z, k
),
chosen AS (
  SELECT x, y FROM aps, params WHERE period = t - 1 GROUP BY x, y ORDER BY sum(ap_micro) DESC, x, y LIMIT 1
),
blend AS (
  SELECT CAST(sum(ap_micro) AS BIGINT) / (count(*) * 1000000) AS map_blend
  FROM aps JOIN chosen USING (x, y), params WHERE period = t
),
single AS (
  SELECT model, CAST(sum(ap_micro) AS BIGINT) / (count(*) * 1000000) AS map
  FROM client_ap, params WHERE period = t GROUP BY model
),
best AS (SELECT model AS best_model, map AS map_best FROM single ORDER BY map DESC, model LIMIT 1)
SELECT map_blend, map_best, best_model, map_blend - map_best AS gain,
       100 * (map_blend - map_best) / greatest(map_best, 1e-9) AS gain_pct
FROM blend, best
