, numbered AS (
  SELECT entity, period, row_number() OVER (PARTITION BY entity ORDER BY period) AS rn FROM rowfeats
),
placed AS (SELECT f.*, n.rn FROM feats f JOIN numbered n ON n.entity = f.entity AND n.period = f.period)
SELECT n.entity, n.period, CAST(s.rn - greatest(n.rn - 16, 1) AS INTEGER) AS step, s.idx, nx.added AS label
FROM numbered n
JOIN placed s ON s.entity = n.entity AND s.rn >= n.rn - 16 AND s.rn <= n.rn - 2
JOIN placed nx ON nx.entity = s.entity AND nx.rn = s.rn + 1 AND nx.idx = s.idx
WHERE s.prev = 0
