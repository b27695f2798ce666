SELECT entity, period, idx, item FROM feats WHERE added = 1
