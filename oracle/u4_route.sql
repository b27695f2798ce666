, bands(segment, lo, hi) AS (VALUES ('0', 0, 0), ('1', 1, 1), ('2-3', 2, 3), ('4-5', 4, 5), ('6+', 6, 2147483647)),
means AS (
  SELECT period, segment, model, count(*) AS clients, CAST(sum(ap_micro) AS BIGINT) AS ap_sum
  FROM client_ap JOIN bands ON n_prev BETWEEN lo AND hi GROUP BY 1, 2, 3
),
rule AS (
  SELECT segment, model FROM means, params WHERE period = t - 1
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY ap_sum DESC, model) = 1
),
overall AS (
  SELECT model FROM client_ap, params WHERE period = t - 1 GROUP BY model ORDER BY sum(ap_micro) DESC, model LIMIT 1
)
SELECT m.segment, clients, m.model AS chosen, ap_sum, ap_sum / (clients * 1000000) AS map
FROM means m LEFT JOIN rule r ON r.segment = m.segment, overall o, params
WHERE m.period = t AND m.model = coalesce(r.model, o.model)
