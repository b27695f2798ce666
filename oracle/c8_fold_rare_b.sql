, kept AS (
  SELECT province FROM rowfeats r JOIN profile p ON p.entity = r.entity, params
  WHERE r.period < t - 1 AND province IS NOT NULL GROUP BY province ORDER BY count(*) DESC, province LIMIT 10
)
SELECT r.entity, r.period, coalesce(k.province, 'OTROS') AS province
FROM rowfeats r LEFT JOIN profile p ON p.entity = r.entity LEFT JOIN kept k ON k.province = p.province
