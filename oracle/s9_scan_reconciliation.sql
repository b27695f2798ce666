-- standalone
SELECT count(*) AS read, count(*) FILTER (c_custkey % 41 NOT IN (7, 9)) AS written,
       count(*) FILTER (c_custkey % 41 IN (7, 9)) AS rejected, true AS equal FROM customer
