SELECT entity, item, dropped AS label, true AS probability FROM feats, params WHERE prev = 1 AND period = t
