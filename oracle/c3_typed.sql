-- standalone
SELECT CAST(o_orderkey AS INTEGER) AS order_id,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS priority,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day,
       CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS price,
       CAST(CASE WHEN o_orderkey % 40 = 0 THEN -999999 ELSE o_orderkey % 100 END AS INTEGER) AS seniority
FROM orders
