, candidates(n) AS (VALUES (2), (4), (8)),
counted AS (
  SELECT n, c.idx, CAST(coalesce(sum(added), 0) AS BIGINT) AS adds
  FROM candidates CROSS JOIN cat c CROSS JOIN params
  LEFT JOIN feats f ON f.idx = c.idx AND f.period < t - 1 AND f.period >= t - 1 - n GROUP BY n, c.idx
),
lists AS (
  SELECT l.entity, l.period, n, l.added, l.n_adds,
         row_number() OVER (PARTITION BY l.entity, l.period, n ORDER BY adds DESC, l.idx) AS pos
  FROM long l JOIN counted c ON c.idx = l.idx, params WHERE l.period IN (t - 1, t) AND prev = 0 AND n_adds > 0
),
found AS (
  SELECT *, sum(added) OVER (PARTITION BY entity, period, n ORDER BY pos ROWS UNBOUNDED PRECEDING) AS found FROM lists
),
aps AS (
  SELECT entity, period, n, CAST(floor(sum(CASE WHEN added = 1 AND pos <= k THEN CAST(found AS DOUBLE) / pos ELSE 0.0 END)
         / least(any_value(n_adds), k) * 1000000 + 0.5) AS BIGINT) AS ap_micro
  FROM found, params GROUP BY entity, period, n, k
),
means AS (
  SELECT 'last_' || n AS candidate,
         (CAST(sum(ap_micro) FILTER (period = t - 1) AS BIGINT) / (count(*) FILTER (period = t - 1) * 1000000)) AS map_decision,
         (CAST(sum(ap_micro) FILTER (period = t) AS BIGINT) / (count(*) FILTER (period = t) * 1000000)) AS map_measured
  FROM aps, params GROUP BY n
)
SELECT candidate, map_decision, map_measured, (SELECT count(*) FROM means) AS candidates,
       (SELECT max(map_decision) - min(map_decision) FROM means) AS search_range
FROM means ORDER BY map_decision DESC, candidate LIMIT 1
