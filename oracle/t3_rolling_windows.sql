SELECT CAST(evaluated AS INTEGER) AS evaluated, count(*) AS rows, min(period) AS first_period, max(period) AS last_period,
       CAST(sum(n_adds) AS BIGINT) AS adds
FROM rowfeats, params, (SELECT t - i AS evaluated FROM params, range(0, 4) r(i)) e
WHERE period < evaluated AND period >= evaluated - 4 GROUP BY evaluated
