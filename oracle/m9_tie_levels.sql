SELECT count(DISTINCT p) AS levels, count(*) AS rows FROM drop_scores, params WHERE period = t
