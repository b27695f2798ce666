SELECT count(*) AS rows, true AS accepted, max(n_adds) > 1 AS refused FROM rowfeats
