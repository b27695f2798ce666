, drawn AS (
  SELECT *, row_number() OVER (PARTITION BY entity, period, added ORDER BY
           ('0x' || substr(md5(concat_ws(':', entity, period, idx, 0)), 1, 15))::BIGINT, idx) AS place
  FROM buy_scores WHERE n_adds > 0 AND prev = 0
),
listed AS (
  SELECT entity, period, idx, item, added, n_adds, score,
         row_number() OVER (PARTITION BY entity, period ORDER BY score DESC, idx) AS rank
  FROM drawn WHERE added = 1 OR place <= (SELECT CASE WHEN count(*) < 10 THEN 2 ELSE 6 END FROM cat)
),
ideal AS (
  SELECT a.n AS n_adds, sum(1 / log2(1 + b.n)) AS best
  FROM (SELECT unnest(range(1, 63)) AS n) a JOIN (SELECT unnest(range(1, 63)) AS n) b ON b.n <= a.n GROUP BY 1
),
pairs AS (
  SELECT g.entity, g.period, g.idx AS good, b.idx AS bad,
         1 / (1 + exp(g.score - b.score)) AS wrong, abs(1 / log2(1 + g.rank) - 1 / log2(1 + b.rank)) / best AS swap
  FROM listed g JOIN listed b ON b.entity = g.entity AND b.period = g.period AND b.added = 0
  JOIN ideal ON ideal.n_adds = g.n_adds WHERE g.added = 1
),
pulls AS (
  SELECT *, CAST(floor(wrong * swap * 1000000 + 0.5) AS BIGINT) AS pull,
         CAST(floor(wrong * (1 - wrong) * swap * 1000000 + 0.5) AS BIGINT) AS bend FROM pairs
),
sums AS (
  SELECT entity, period, good AS idx, -pull AS pull, bend FROM pulls
  UNION ALL SELECT entity, period, bad, pull, bend FROM pulls
)
SELECT l.entity, l.period, l.item, CAST(l.added AS INTEGER) AS label,
       CAST(coalesce(sum(pull), 0) AS BIGINT) AS gradient, CAST(coalesce(sum(bend), 0) AS BIGINT) AS hessian
FROM listed l LEFT JOIN sums s ON s.entity = l.entity AND s.period = l.period AND s.idx = l.idx
GROUP BY l.entity, l.period, l.item, l.added
