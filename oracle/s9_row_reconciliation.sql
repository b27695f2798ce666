-- standalone
SELECT count(*) AS source_rows, count(*) AS written_rows, true AS equal FROM orders
