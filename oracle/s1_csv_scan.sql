-- standalone
WITH parts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer, c_custkey % 41 AS rest, c_name, c_mktsegment AS segment,
         CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS balance FROM customer
)
SELECT CASE WHEN rest NOT IN (7, 9) THEN customer END AS customer,
       CASE WHEN rest NOT IN (7, 9) THEN concat(c_name, ', "', segment, '"') END AS name,
       CASE WHEN rest NOT IN (7, 9) THEN segment END AS segment, CASE WHEN rest NOT IN (7, 9) THEN balance END AS balance,
       CASE rest WHEN 7 THEN concat(customer, ',', c_name)
            WHEN 9 THEN concat(customer, ',"', c_name, ', ""', segment, '""",', segment, ',', balance, ',more,fields') END AS rejected_line
FROM parts
