, steps AS (
  SELECT entity, period, period - lag(period) OVER (PARTITION BY entity ORDER BY period) AS step FROM observed
)
SELECT rows_in, rows_out, first_rows, gap_rows, rows_in - rows_out AS discarded,
       100 * (rows_in - rows_out) / rows_in AS pct_discarded
FROM (
  SELECT count(*) AS rows_in, count(*) FILTER (step = 1) AS rows_out,
         count(*) FILTER (step IS NULL) AS first_rows, count(*) FILTER (step > 1) AS gap_rows
  FROM steps
)
