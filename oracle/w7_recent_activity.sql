SELECT entity, period, adds_recent, drops_recent FROM rowfeats
