, drawn AS (
  SELECT *, row_number() OVER (PARTITION BY entity, period, added ORDER BY
           ('0x' || substr(md5(concat_ws(':', entity, period, idx, 0)), 1, 15))::BIGINT, idx) AS place
  FROM long WHERE n_adds > 0 AND prev = 0
)
SELECT entity, period, idx, item, added AS label
FROM drawn WHERE added = 1 OR place <= (SELECT CASE WHEN count(*) < 10 THEN 2 ELSE 6 END FROM cat)
