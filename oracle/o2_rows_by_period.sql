SELECT period, count(*) AS rows FROM observed GROUP BY period
