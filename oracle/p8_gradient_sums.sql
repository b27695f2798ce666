, examples AS (
  SELECT f.entity, f.period, f.idx AS label, r.n_prev, r.adds_recent, r.drops_recent, r.history, r.season
  FROM feats f JOIN rowfeats r ON r.entity = f.entity AND r.period = f.period, params
  WHERE f.added = 1 AND f.period < t - 1
),
counts AS (
  UNPIVOT (SELECT entity, period, label, CAST(n_prev AS BIGINT) AS n_prev, CAST(adds_recent AS BIGINT) AS adds_recent,
           CAST(drops_recent AS BIGINT) AS drops_recent, CAST(history AS BIGINT) AS history, CAST(season AS BIGINT) AS season
           FROM examples)
  ON n_prev, adds_recent, drops_recent, history, season INTO NAME feature VALUE amount
),
cells AS (
  SELECT label, feature, least(amount, 31) AS bin FROM counts
  UNION ALL
  SELECT e.label, concat('held_', p.idx), p.prev FROM examples e JOIN feats p ON p.entity = e.entity AND p.period = e.period
),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cat)
SELECT c.item, feature, CAST(bin AS INTEGER) AS bin,
       CAST(sum(floor((1 / n - CAST(label = c.idx AS INTEGER)) * 1000000 + 0.5)) AS BIGINT) AS gradient,
       CAST(sum(floor(2 * (1 / n) * (1 - 1 / n) * 1000000 + 0.5)) AS BIGINT) AS hessian
FROM cells CROSS JOIN cat c CROSS JOIN size GROUP BY ALL
