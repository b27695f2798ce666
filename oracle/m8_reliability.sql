SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS rows,
       CAST(sum(CAST(floor(p * 1000000 + 0.5) AS BIGINT)) AS BIGINT) / (count(*) * 1000000) AS promised,
       CAST(sum(label) AS BIGINT) / count(*) AS observed
FROM drop_scores, params WHERE period = t GROUP BY 1
