, bands(segment, lo, hi) AS (VALUES ('0', 0, 0), ('1', 1, 1), ('2-3', 2, 3), ('4-5', 4, 5), ('6+', 6, 2147483647)),
means AS (
  SELECT period, segment, model, sum(ap_micro) AS ap_sum
  FROM client_ap JOIN bands ON n_prev BETWEEN lo AND hi GROUP BY 1, 2, 3
),
winners AS (
  SELECT period, segment, model FROM means
  QUALIFY row_number() OVER (PARTITION BY period, segment ORDER BY ap_sum DESC, model) = 1
)
SELECT count(*) AS segments, count(*) FILTER (b.model IS DISTINCT FROM a.model) AS changed
FROM winners a JOIN params ON a.period = t LEFT JOIN winners b ON b.segment = a.segment AND b.period = t - 1
