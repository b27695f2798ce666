SELECT r.entity, r.period, income, CAST(income IS NULL AS DOUBLE) AS income_missing,
       CAST(prev_activity AS DOUBLE) AS prev_activity, CAST(prev_activity IS NULL AS DOUBLE) AS prev_activity_missing
FROM rowfeats r LEFT JOIN profile p ON p.entity = r.entity
