SELECT entity, period, history FROM rowfeats
