SELECT entity, period, idx, tenure FROM feats
