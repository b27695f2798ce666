SELECT entity, period,
       CASE WHEN history <= 1 THEN '1' WHEN history <= 3 THEN '2-3' WHEN history <= 6 THEN '4-6'
            WHEN history <= 11 THEN '7-11' ELSE '12+' END AS by_history,
       CASE WHEN n_prev = 0 THEN '0' WHEN n_prev = 1 THEN '1' WHEN n_prev <= 3 THEN '2-3'
            WHEN n_prev <= 5 THEN '4-5' ELSE '6+' END AS by_holdings
FROM rowfeats
