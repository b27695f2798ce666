, calendar AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events GROUP BY 1
),
cutoff AS (SELECT max(period) AS c FROM calendar WHERE DATE '2024-01-30' BETWEEN first AND last)
SELECT entity, period, CAST(sum(CAST(held AS BIGINT) << idx) AS BIGINT) AS held, max(activity) AS activity
FROM states, cutoff WHERE period = c GROUP BY entity, period
