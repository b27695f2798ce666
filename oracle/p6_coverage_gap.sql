, known AS (
  SELECT DISTINCT entity FROM feats, params WHERE prev = 1 AND period < t - 1
),
sides AS (
  SELECT DISTINCT 'train' AS side, entity FROM rowfeats, params WHERE n_adds > 0 AND period < t - 1
  UNION ALL
  SELECT DISTINCT 'serve' AS side, entity FROM rowfeats, params WHERE period = t
),
counts AS (
  SELECT count(*) FILTER (side = 'train') AS train_ids, count(k.entity) FILTER (side = 'train') AS train_covered,
         count(*) FILTER (side = 'serve') AS serve_ids, count(k.entity) FILTER (side = 'serve') AS serve_covered
  FROM sides s LEFT JOIN known k ON k.entity = s.entity
),
shares AS (
  SELECT *, 100 * train_covered / greatest(train_ids, 1) AS train_pct, 100 * serve_covered / greatest(serve_ids, 1) AS serve_pct
  FROM counts
)
SELECT *, abs(train_pct - serve_pct) AS gap, abs(train_pct - serve_pct) > 15 AS warn FROM shares
