SELECT entity, period, idx, item, dropped AS label, tenure FROM feats WHERE prev = 1
