, portfolio AS (
  SELECT entity, coalesce(max(score) FILTER (prev = 0), 0.0) AS prob_buy, CAST(any_value(n_adds) > 0 AS INTEGER) AS took_up
  FROM buy_scores, params WHERE period = t GROUP BY entity
),
points(pct_base, q) AS (VALUES (1.0, 990), (2.0, 980), (5.0, 950), (10.0, 900), (20.0, 800), (50.0, 500)),
levels AS (
  SELECT prob_buy, sum(count(*)) OVER (ORDER BY prob_buy) AS upto, sum(count(*)) OVER () AS total FROM portfolio GROUP BY prob_buy
),
cuts AS (SELECT pct_base, min(prob_buy) AS cut FROM points JOIN levels ON upto * 1000 >= total * q GROUP BY pct_base),
counts AS (
  SELECT pct_base, count(*) FILTER (prob_buy >= cut) AS contacted,
         CAST(sum(took_up) FILTER (prob_buy >= cut) AS BIGINT) AS hits, count(*) AS n, CAST(sum(took_up) AS BIGINT) AS pos
  FROM cuts, portfolio GROUP BY pct_base
)
SELECT CAST(pct_base AS DOUBLE) AS pct_base, contacted, hits, 100 * contacted / n AS pct_contacted, 100 * hits / pos AS pct_captured,
       (100 * hits / pos) / (100 * contacted / n) AS multiplier
FROM counts
