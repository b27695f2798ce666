-- standalone
SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'NA' ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
       CASE WHEN o_orderkey % 50 = 0 THEN 'n/d' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
       CASE WHEN o_orderkey % 40 = 0 THEN '-999999' ELSE CAST(o_orderkey % 100 AS VARCHAR) END AS seniority
FROM orders
