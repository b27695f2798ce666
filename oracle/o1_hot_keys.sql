-- standalone
SELECT event_type, true AS hot FROM events GROUP BY event_type
HAVING count(*) > ceil((SELECT count(*) FROM events) / 16)
