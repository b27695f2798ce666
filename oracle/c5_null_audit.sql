-- standalone
WITH counts(name, nulls) AS (
  SELECT 'priority', count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') FROM orders
  UNION ALL SELECT 'day', count(*) FILTER (o_orderstatus = 'P') FROM orders
  UNION ALL SELECT 'price', count(*) FILTER (o_orderkey % 50 = 0) FROM orders
  UNION ALL SELECT 'seniority', count(*) FILTER (o_orderkey % 40 = 0) FROM orders
)
SELECT name AS column, nulls, 100 * nulls / (SELECT count(*) FROM orders) AS pct FROM counts
