, bands(segment, lo, hi) AS (VALUES ('1', 0, 1), ('2-3', 2, 3), ('4-6', 4, 6), ('7-11', 7, 11), ('12+', 12, 2147483647)),
means AS (
  SELECT period, segment, model, count(*) AS clients, CAST(sum(ap_micro) AS BIGINT) AS ap_sum
  FROM client_ap JOIN bands ON history BETWEEN lo AND hi GROUP BY 1, 2, 3
)
SELECT period, segment, clients, model AS winner, ap_sum / (clients * 1000000) AS map
FROM means QUALIFY row_number() OVER (PARTITION BY period, segment ORDER BY ap_sum DESC, model) = 1
