SELECT count(*) AS rows, true AS equal FROM feats, params WHERE prev = 1 AND period = t
