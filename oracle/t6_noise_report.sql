, seeds(seed) AS (VALUES (1), (2), (3)),
rates AS (
  SELECT seed, idx, least(n_prev, 8) AS band, CAST(sum(added) AS BIGINT) AS num, count(*) AS den
  FROM long, params, seeds
  WHERE prev = 0 AND period < t - 1
    AND ('0x' || substr(md5(concat_ws(':', entity, period, '', seed)), 1, 15))::BIGINT % 1000 < 400
  GROUP BY 1, 2, 3
),
lists AS (
  SELECT l.entity, s.seed, l.added, l.n_adds,
         row_number() OVER (PARTITION BY l.entity, s.seed ORDER BY coalesce(num / den, 0.0) DESC, l.idx) AS pos
  FROM long l CROSS JOIN seeds s
  LEFT JOIN rates r ON r.seed = s.seed AND r.idx = l.idx AND r.band = least(l.n_prev, 8), params
  WHERE period = t - 1 AND prev = 0 AND n_adds > 0
),
found AS (
  SELECT *, sum(added) OVER (PARTITION BY entity, seed ORDER BY pos ROWS UNBOUNDED PRECEDING) AS found FROM lists
),
aps AS (
  SELECT entity, seed, CAST(floor(sum(CASE WHEN added = 1 AND pos <= k THEN CAST(found AS DOUBLE) / pos ELSE 0.0 END)
         / least(any_value(n_adds), k) * 1000000 + 0.5) AS BIGINT) AS ap_micro
  FROM found, params GROUP BY entity, seed, k
),
means AS (SELECT seed, CAST(sum(ap_micro) AS BIGINT) / (count(*) * 1000000) AS map FROM aps GROUP BY seed)
SELECT count(*) AS reruns, CAST(floor(avg(map) * 1000000 + 0.5) AS BIGINT) AS mean_map_micro,
       CAST(floor(stddev_pop(map) * 1000000 + 0.5) AS BIGINT) AS std_map_micro,
       0.002 > stddev_pop(map) AS gain_above_noise
FROM means
