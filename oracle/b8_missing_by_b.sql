SELECT province, count(*) AS rows, count(*) FILTER (income IS NULL) / count(*) AS missing_rate FROM profile GROUP BY province
