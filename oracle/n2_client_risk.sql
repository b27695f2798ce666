SELECT entity, max(p) AS prob_drop FROM drop_scores, params WHERE period = t GROUP BY entity
