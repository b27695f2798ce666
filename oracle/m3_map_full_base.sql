, base AS (SELECT count(*) AS base FROM rowfeats, params WHERE period = t)
SELECT count(*) AS clients, base, CAST(sum(ap_micro) AS BIGINT) / (count(*) * 1000000) AS map,
       CAST(sum(ap_micro) AS BIGINT) / (base * 1000000) AS map_full_base
FROM popular_ap, base GROUP BY base
