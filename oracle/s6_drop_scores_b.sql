-- standalone
WITH bought AS (
  SELECT DISTINCT o_custkey AS entity, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS period,
         p_brand AS item
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
),
seen AS (SELECT DISTINCT entity, period FROM bought),
rows AS (
  SELECT entity, period, lag(period) OVER (PARTITION BY entity ORDER BY period) AS before FROM seen
),
usable AS (SELECT entity, period FROM rows WHERE period - before = 1),
held AS (  -- items of the period before, and whether they are still there
  SELECT u.entity, u.period, b.item, CAST(n.item IS NULL AS INTEGER) AS label
  FROM usable u JOIN bought b ON b.entity = u.entity AND b.period = u.period - 1
  LEFT JOIN bought n ON n.entity = u.entity AND n.period = u.period AND n.item = b.item
),
tenured AS (  -- in how many of the last six usable periods the item was held before
  SELECT h.entity, h.period, h.item, h.label, count(*) AS tenure
  FROM held h JOIN held o ON o.entity = h.entity AND o.item = h.item AND o.period BETWEEN h.period - 5 AND h.period
  GROUP BY 1, 2, 3, 4
),
rates AS (
  SELECT item, tenure, CAST(sum(label) AS BIGINT) AS num, count(*) AS den FROM tenured WHERE period < 24 GROUP BY 1, 2
),
item_rates AS (SELECT item, CAST(sum(num) AS BIGINT) AS num, CAST(sum(den) AS BIGINT) AS den FROM rates GROUP BY 1)
SELECT t.entity, t.item, coalesce(r.num / r.den, 0.0) AS prob_drop,
       CASE WHEN r.num IS NULL THEN 0.0 ELSE i.num / i.den END AS prob_drop_raw
FROM tenured t LEFT JOIN rates r ON r.item = t.item AND r.tenure = t.tenure LEFT JOIN item_rates i ON i.item = t.item
WHERE t.period = 25
