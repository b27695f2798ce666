SELECT entity, period, place, idx, 1.0::DOUBLE / (60.0::DOUBLE + place) AS rank_score
FROM model_ranks WHERE model = 'conditional_rate'
