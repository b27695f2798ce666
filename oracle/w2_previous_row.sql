SELECT entity, period, max(prev_period) AS prev_period,
       CAST(sum(CAST(prev_held AS BIGINT) << idx) AS BIGINT) AS prev_bits, max(prev_activity) AS prev_activity
FROM lagged GROUP BY entity, period
