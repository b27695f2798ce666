-- the long panel: every observed (entity, period) crossed with the catalogue
held_items AS (SELECT DISTINCT entity, period, item FROM source_rows),
observed AS (
  SELECT entity, period, count(DISTINCT source_id) AS activity FROM source_rows GROUP BY 1, 2
),
states AS (
  SELECT o.entity, o.period, o.activity, c.item, c.idx, CAST(h.item IS NOT NULL AS INTEGER) AS held
  FROM observed o CROSS JOIN cat c
  LEFT JOIN held_items h ON h.entity = o.entity AND h.period = o.period AND h.item = c.item
),
lagged AS (
  SELECT *, lag(held) OVER w AS prev_held, lag(period) OVER w AS prev_period, lag(activity) OVER w AS prev_activity
  FROM states WINDOW w AS (PARTITION BY entity, item ORDER BY period)
),
feats AS (
  SELECT entity, period, item, idx, held, prev_held AS prev, prev_activity,
         CAST(held = 1 AND prev_held = 0 AS INTEGER) AS added,
         CAST(held = 0 AND prev_held = 1 AS INTEGER) AS dropped,
         CAST(sum(prev_held) OVER (PARTITION BY entity, item ORDER BY period
              RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS INTEGER) AS tenure
  FROM lagged WHERE period - prev_period = 1
),
row_sums AS (
  SELECT entity, period, max(prev_activity) AS prev_activity, CAST(sum(prev) AS INTEGER) AS n_prev,
         CAST(sum(added) AS INTEGER) AS n_adds, CAST(sum(dropped) AS INTEGER) AS n_drops,
         CAST(sum(CAST(prev AS BIGINT) << idx) AS BIGINT) AS prev_bits,
         CAST(sum(CAST(added AS BIGINT) << idx) AS BIGINT) AS add_bits,
         CAST(sum(CAST(dropped AS BIGINT) << idx) AS BIGINT) AS drop_bits
  FROM feats GROUP BY 1, 2
),
rowfeats AS (
  SELECT r.*, period % season_length + 1 AS season,
         CAST(coalesce(sum(n_adds) OVER recent, 0) AS BIGINT) AS adds_recent,
         CAST(coalesce(sum(n_drops) OVER recent, 0) AS BIGINT) AS drops_recent,
         count(*) OVER (PARTITION BY entity ORDER BY period
              RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history
  FROM row_sums r, params
  WINDOW recent AS (PARTITION BY entity ORDER BY period RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)
),
long AS (SELECT f.*, r.n_prev, r.n_adds, r.history FROM feats f JOIN rowfeats r USING (entity, period)),
-- popularity before t, and conditional rates learnt before t - 1
pop AS (
  SELECT idx, item, CAST(sum(added) AS BIGINT) AS adds, row_number() OVER (ORDER BY sum(added) DESC, idx) AS rank
  FROM feats, params WHERE period < t GROUP BY idx, item
),
add_rates AS (
  SELECT idx, least(n_prev, 8) AS band, sum(added) AS num, count(*) AS den
  FROM long, params WHERE prev = 0 AND period < t - 1 GROUP BY 1, 2
),
buy_scores AS (
  SELECT l.*, coalesce(CAST(num AS BIGINT) / CAST(den AS BIGINT), 0.0) AS score
  FROM long l LEFT JOIN add_rates a ON a.idx = l.idx AND a.band = least(l.n_prev, 8), params
  WHERE period IN (t - 1, t)
),
drop_rates AS (
  SELECT idx, tenure, CAST(sum(dropped) AS BIGINT) AS num, count(*) AS den
  FROM feats, params WHERE prev = 1 AND period < t - 1 GROUP BY 1, 2
),
item_drop_rates AS (SELECT idx, CAST(sum(num) AS BIGINT) AS num, CAST(sum(den) AS BIGINT) AS den FROM drop_rates GROUP BY 1),
drop_scores AS (
  SELECT f.entity, f.period, f.idx, f.item, f.dropped AS label, f.tenure,
         coalesce(d.num / d.den, 0.0) AS p,
         CASE WHEN d.num IS NULL THEN 0.0 ELSE i.num / i.den END AS p_item
  FROM feats f LEFT JOIN drop_rates d ON d.idx = f.idx AND d.tenure = f.tenure
  LEFT JOIN item_drop_rates i ON i.idx = f.idx, params
  WHERE prev = 1 AND period IN (t - 1, t)
),
-- three models learnt before t - 1 and scored on t - 1 and t
train_counts AS (
  SELECT idx, CAST(sum(added) AS BIGINT) AS adds FROM long, params WHERE period < t - 1 GROUP BY 1
),
band_counts AS (
  SELECT idx, least(n_prev, 8) AS band, CAST(sum(added) AS BIGINT) AS adds
  FROM long, params WHERE period < t - 1 GROUP BY 1, 2
),
model_scores AS (
  SELECT l.*, 'popularity' AS model, CAST(adds AS DOUBLE) AS score
  FROM long l JOIN train_counts c ON c.idx = l.idx, params WHERE period IN (t - 1, t)
  UNION ALL
  SELECT l.*, 'popularity_by_band' AS model, CAST(coalesce(adds, 0) AS DOUBLE) AS score
  FROM long l LEFT JOIN band_counts c ON c.idx = l.idx AND c.band = least(l.n_prev, 8), params
  WHERE period IN (t - 1, t)
  UNION ALL
  SELECT * EXCLUDE (score), 'conditional_rate' AS model, score FROM buy_scores
),
model_ranks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY entity, period, model ORDER BY score DESC, idx) - 1 AS INTEGER) AS place
  FROM model_scores
),
open_lists AS (
  SELECT entity, period, model, idx, added, n_adds, history, n_prev,
         row_number() OVER (PARTITION BY entity, period, model ORDER BY score DESC, idx) AS pos
  FROM model_scores WHERE prev = 0
),
hits AS (
  SELECT *, sum(added) OVER (PARTITION BY entity, period, model ORDER BY pos ROWS UNBOUNDED PRECEDING) AS found
  FROM open_lists
),
client_ap AS (
  SELECT entity, period, model, any_value(history) AS history, any_value(n_prev) AS n_prev,
         CAST(floor(sum(CASE WHEN added = 1 AND pos <= k THEN CAST(found AS DOUBLE) / pos ELSE 0.0 END)
              / least(any_value(n_adds), k) * 1000000 + 0.5) AS BIGINT) AS ap_micro
  FROM hits, params WHERE n_adds > 0 GROUP BY entity, period, model, k
),
-- popularity before t, as lists for t
popular_lists AS (
  SELECT l.entity, l.idx, l.item, l.added, l.n_adds,
         row_number() OVER (PARTITION BY l.entity ORDER BY p.rank) AS pos
  FROM long l JOIN pop p ON p.idx = l.idx, params WHERE l.period = t AND l.prev = 0
),
popular_hits AS (
  SELECT *, sum(added) OVER (PARTITION BY entity ORDER BY pos ROWS UNBOUNDED PRECEDING) AS found FROM popular_lists
),
popular_ap AS (
  SELECT entity, CAST(floor(sum(CASE WHEN added = 1 AND pos <= k THEN CAST(found AS DOUBLE) / pos ELSE 0.0 END)
              / least(any_value(n_adds), k) * 1000000 + 0.5) AS BIGINT) AS ap_micro
  FROM popular_hits, params WHERE n_adds > 0 GROUP BY entity, k
),
prelude_end AS (SELECT 1 AS one)
