, held_text AS (
  SELECT entity, period, string_agg(CAST(CAST(prev AS DOUBLE) AS VARCHAR), ',' ORDER BY idx) AS flags FROM feats GROUP BY 1, 2
)
SELECT r.entity, r.period, concat_ws(',', CAST(CAST(n_prev AS DOUBLE) AS VARCHAR), CAST(CAST(adds_recent AS DOUBLE) AS VARCHAR), CAST(CAST(drops_recent AS DOUBLE) AS VARCHAR), CAST(CAST(history AS DOUBLE) AS VARCHAR), CAST(CAST(season AS DOUBLE) AS VARCHAR), CAST(CAST(prev_activity AS DOUBLE) AS VARCHAR), '0.0,0.0,0.0,0.0,0.0,0.0', flags) AS features
FROM rowfeats r JOIN held_text h ON h.entity = r.entity AND h.period = r.period, params WHERE r.period <= t
