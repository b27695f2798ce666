, kept AS (
  SELECT province FROM rowfeats r JOIN profile p ON p.entity = r.entity, params
  WHERE r.period < t - 1 AND province IS NOT NULL GROUP BY province ORDER BY count(*) DESC, province LIMIT 20
),
prof AS (
  SELECT r.*, p.segment, coalesce(k.province, 'OTROS') AS province, p.region, p.income, r.period < t - 1 AS train, r.period <= t AS shown
  FROM rowfeats r LEFT JOIN profile p ON p.entity = r.entity LEFT JOIN kept k ON k.province = p.province, params
),
segments AS (
  SELECT segment AS v, row_number() OVER (ORDER BY count(*) DESC, segment) - 1 AS i FROM prof WHERE train AND segment IS NOT NULL GROUP BY segment
),
provinces AS (
  SELECT province AS v, row_number() OVER (ORDER BY count(*) DESC, province) - 1 AS i FROM prof WHERE train AND province IS NOT NULL GROUP BY province
),
regions AS (
  SELECT region AS v, row_number() OVER (ORDER BY count(*) DESC, region) - 1 AS i FROM prof WHERE train AND region IS NOT NULL GROUP BY region
),
coded AS (
  SELECT f.*, coalesce(a.i, (SELECT count(*) FROM segments)) AS segment_i, coalesce(b.i, (SELECT count(*) FROM provinces)) AS province_i,
         coalesce(c.i, (SELECT count(*) FROM regions)) AS region_i
  FROM prof f LEFT JOIN segments a ON a.v = f.segment LEFT JOIN provinces b ON b.v = f.province LEFT JOIN regions c ON c.v = f.region
)
SELECT entity, period, CAST(segment_i AS DOUBLE) AS segment_index, CAST(province_i AS DOUBLE) AS province_index,
       CAST(region_i AS DOUBLE) AS region_index FROM coded
