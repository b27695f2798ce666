, buy AS (
  SELECT entity, coalesce(max(score) FILTER (prev = 0), 0.0) AS prob_buy FROM buy_scores, params WHERE period = t GROUP BY entity
),
risk AS (SELECT entity, max(p) AS prob_drop FROM drop_scores, params WHERE period = t GROUP BY entity),
joined AS (SELECT b.entity, prob_buy, coalesce(prob_drop, 0.0) AS prob_drop FROM buy b LEFT JOIN risk r ON r.entity = b.entity)
SELECT quantile_disc(prob_buy, 0.8) AS cut_prob_buy, quantile_disc(prob_drop, 0.8) AS cut_prob_drop FROM joined
