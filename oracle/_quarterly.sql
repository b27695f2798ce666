WITH params(k, t, season_length) AS (VALUES (7, 25, 4)),
cat(item, idx) AS (SELECT 'Brand#' || CAST(i AS VARCHAR), CAST(i - 1 AS INTEGER) FROM range(1, 26) r(i)),
source_rows AS (
  SELECT o_custkey AS entity,
         CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS period,
         p_brand AS item, o_orderkey AS source_id
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
),
profile AS (
  SELECT c_custkey AS entity, c_mktsegment AS segment, n_name AS province, r_name AS region,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS income
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
),
