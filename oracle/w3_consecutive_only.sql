SELECT entity, period, CAST(sum(CAST(held AS BIGINT) << idx) AS BIGINT) AS held,
       CAST(sum(CAST(prev AS BIGINT) << idx) AS BIGINT) AS prev_bits
FROM feats GROUP BY entity, period
