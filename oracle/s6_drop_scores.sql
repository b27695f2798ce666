SELECT entity, item, p AS prob_drop, p_item AS prob_drop_raw FROM drop_scores, params WHERE period = t
