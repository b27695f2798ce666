, texts AS (
  SELECT entity, period, string_agg(CAST(prev AS VARCHAR), ',' ORDER BY idx) AS prev,
         string_agg(CAST(added AS VARCHAR), ',' ORDER BY idx) AS added,
         string_agg(CAST(dropped AS VARCHAR), ',' ORDER BY idx) AS dropped,
         string_agg(CAST(tenure AS VARCHAR), ',' ORDER BY idx) AS tenures
  FROM feats GROUP BY entity, period
)
SELECT r.entity, r.period, season, prev_activity, n_prev, n_adds, n_drops, adds_recent, drops_recent, history,
       prev, added, dropped, tenures
FROM rowfeats r JOIN texts x ON x.entity = r.entity AND x.period = r.period
