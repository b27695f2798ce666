SELECT period, CASE WHEN history <= 1 THEN '1' WHEN history <= 3 THEN '2-3' WHEN history <= 6 THEN '4-6'
              WHEN history <= 11 THEN '7-11' ELSE '12+' END AS segment,
       count(*) AS clients, true AS known
FROM rowfeats, params WHERE n_adds > 0 AND period IN (t - 1, t) GROUP BY 1, 2
