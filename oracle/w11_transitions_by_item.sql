, totals AS (
  SELECT idx, item, CAST(sum(added) AS BIGINT) AS adds, CAST(sum(dropped) AS BIGINT) AS drops
  FROM feats GROUP BY idx, item
)
SELECT idx, item, adds, drops, CAST(row_number() OVER (ORDER BY adds DESC, idx) AS INTEGER) AS rank,
       100 * adds / CAST(greatest(sum(adds) OVER (), 1) AS BIGINT) AS share_pct
FROM totals
