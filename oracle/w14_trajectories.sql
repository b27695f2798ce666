, steps AS (
  SELECT entity, period, list(CAST(prev_bits AS VARCHAR)) OVER past AS s, list(CAST(add_bits AS VARCHAR)) OVER past AS a,
         list(CAST(drop_bits AS VARCHAR)) OVER past AS d
  FROM rowfeats WINDOW past AS (PARTITION BY entity ORDER BY period ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)
)
SELECT entity, period, coalesce(array_to_string(s, ','), '') AS states, coalesce(array_to_string(a, ','), '') AS adds,
       coalesce(array_to_string(d, ','), '') AS drops
FROM steps
