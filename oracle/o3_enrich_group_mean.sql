-- standalone
WITH means AS (
  SELECT c_nationkey, CAST(sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS mean_c_acctbal
  FROM customer WHERE c_acctbal IS NOT NULL GROUP BY c_nationkey
)
SELECT c.c_nationkey, c_custkey, c_acctbal, mean_c_acctbal FROM customer c LEFT JOIN means m ON m.c_nationkey = c.c_nationkey
