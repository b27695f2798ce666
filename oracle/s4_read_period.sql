SELECT entity, period, CAST(sum(CAST(held AS BIGINT) << idx) AS BIGINT) AS held, max(activity) AS activity
FROM states, params WHERE period = t GROUP BY entity, period
