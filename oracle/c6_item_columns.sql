-- standalone
SELECT 'l_orderkey' AS "column", count(l_orderkey) AS rows, true AS guarded FROM lineitem
UNION ALL SELECT 'l_partkey', count(l_partkey), true FROM lineitem
UNION ALL SELECT 'l_suppkey', count(l_suppkey), true FROM lineitem
