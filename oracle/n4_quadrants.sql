, buy AS (
  SELECT entity, coalesce(max(score) FILTER (prev = 0), 0.0) AS prob_buy FROM buy_scores, params WHERE period = t GROUP BY entity
),
risk AS (SELECT entity, max(p) AS prob_drop FROM drop_scores, params WHERE period = t GROUP BY entity),
joined AS (SELECT b.entity, prob_buy, coalesce(prob_drop, 0.0) AS prob_drop FROM buy b LEFT JOIN risk r ON r.entity = b.entity),
cuts AS (SELECT quantile_disc(prob_buy, 0.8) AS cb, quantile_disc(prob_drop, 0.8) AS cr FROM joined),
named AS (
  SELECT CASE WHEN prob_buy >= cb AND prob_drop < cr THEN 'VENDER' WHEN prob_buy >= cb THEN 'RETENER PRIMERO'
              WHEN prob_drop >= cr THEN 'RETENER' ELSE 'NO TOCAR' END AS quadrant
  FROM joined, cuts
)
SELECT quadrant, count(*) AS clients, 100 * count(*) / CAST(sum(count(*)) OVER () AS BIGINT) AS pct FROM named GROUP BY quadrant
