, seen AS (SELECT DISTINCT entity FROM feats, params WHERE prev = 1 AND period < t - 1)
SELECT r.entity, s.entity IS NOT NULL AS known, false AS lists_held
FROM rowfeats r LEFT JOIN seen s ON s.entity = r.entity, params WHERE r.period = t
