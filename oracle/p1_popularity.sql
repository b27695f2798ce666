SELECT idx, item, adds, CAST(rank AS INTEGER) AS rank FROM pop
