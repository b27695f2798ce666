SELECT entity, period, prev_bits, add_bits, drop_bits FROM rowfeats
