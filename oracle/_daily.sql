WITH params(k, t, season_length) AS (VALUES (3, 29, 7)),
cat(item, idx) AS (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)),
source_rows AS (
  SELECT user_id AS entity, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period,
         event_type AS item, event_id AS source_id
  FROM events
),
