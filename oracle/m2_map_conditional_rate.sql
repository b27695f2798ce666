SELECT period, CAST(sum(ap_micro) AS BIGINT) AS ap_sum, count(*) AS clients,
       CAST(sum(ap_micro) AS BIGINT) / (count(*) * 1000000) AS map
FROM client_ap WHERE model = 'conditional_rate' GROUP BY period
