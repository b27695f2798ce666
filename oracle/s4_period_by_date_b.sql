, calendar AS (
  SELECT CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS period, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1
),
cutoff AS (SELECT max(period) AS c FROM calendar WHERE DATE '2001-05-15' BETWEEN first AND last)
SELECT entity, period, CAST(sum(CAST(held AS BIGINT) << idx) AS BIGINT) AS held, max(activity) AS activity
FROM states, cutoff WHERE period = c GROUP BY entity, period
