SELECT entity, period, coalesce(max(score) FILTER (prev = 0), 0.0) AS prob_buy FROM buy_scores GROUP BY entity, period
