, periods AS (SELECT DISTINCT period FROM buy_scores UNION ALL SELECT -1)
SELECT CAST(period AS INTEGER) AS period, 'prob_buy' AS score, CAST(q AS INTEGER) AS per_mille, true AS within
FROM periods CROSS JOIN (SELECT unnest([500, 800, 950, 990]) AS q)
