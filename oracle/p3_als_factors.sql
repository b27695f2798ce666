SELECT idx, true AS good FROM feats, params WHERE prev = 1 AND period < t - 1 GROUP BY idx
