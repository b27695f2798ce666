SELECT entity, period, max(activity) AS activity, CAST(sum(CAST(held AS BIGINT) << idx) AS BIGINT) AS held
FROM states GROUP BY entity, period
