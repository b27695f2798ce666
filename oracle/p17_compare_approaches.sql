, means AS (
  SELECT model, count(*) AS clients, CAST(sum(ap_micro) AS BIGINT) AS ap_sum
  FROM client_ap, params WHERE period = t GROUP BY model
)
SELECT model, clients, ap_sum / (clients * 1000000) AS map,
       ap_sum / (SELECT ap_sum FROM means WHERE model = 'popularity') AS ratio,
       row_number() OVER (ORDER BY ap_sum DESC, model) = 1 AS winner
FROM means
