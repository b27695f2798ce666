SELECT * FROM popular_ap
