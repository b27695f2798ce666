SELECT entity, period, idx, item, prev AS held FROM feats
