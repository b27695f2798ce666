, scored AS (
  SELECT CAST(floor((p - label) * (p - label) * 1000000 + 0.5) AS BIGINT) AS e,
         CAST(floor((p_item - label) * (p_item - label) * 1000000 + 0.5) AS BIGINT) AS e_item
  FROM drop_scores, params WHERE period = t
),
sums AS (SELECT count(*) AS rows, CAST(sum(e) AS BIGINT) AS s, CAST(sum(e_item) AS BIGINT) AS s_item FROM scored)
SELECT rows, s / (rows * 1000000) AS brier_p, s_item / (rows * 1000000) AS brier_p_item,
       100 * (s_item - s) / s_item AS improvement_pct_p
FROM sums
