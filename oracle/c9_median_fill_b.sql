SELECT entity, coalesce(income, (SELECT quantile_disc(income, 0.5) FROM profile)) AS income FROM profile
