, points AS (
  SELECT CAST(floor(p * 1000000 + 0.5) AS BIGINT) AS point, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos
  FROM drop_scores, params WHERE period = t - 1 GROUP BY 1
),
running AS (
  SELECT *, sum(n) OVER (ORDER BY point) AS upto_n, sum(pos) OVER (ORDER BY point) AS upto_pos FROM points
),
spans AS (
  SELECT a.point AS first, b.point AS last,
         CAST(b.upto_pos - a.upto_pos + a.pos AS BIGINT) / CAST(b.upto_n - a.upto_n + a.n AS BIGINT) AS rate
  FROM running a JOIN running b ON a.point <= b.point
),
least_rates AS (
  SELECT x.point, s.first, min(s.rate) AS rate FROM points x JOIN spans s ON s.first <= x.point AND s.last >= x.point GROUP BY 1, 2
)
SELECT p.point, p.n, p.pos, max(l.rate) AS calibrated FROM points p JOIN least_rates l ON l.point = p.point GROUP BY 1, 2, 3
