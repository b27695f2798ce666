SELECT entity, period, n_prev, n_adds, n_drops, season FROM rowfeats
