-- standalone
SELECT CAST(count(*) FILTER (c_acctbal < 0 OR c_acctbal IS NULL) AS DOUBLE) / count(*) AS missing_rate, true AS auc_fit, true AS judged FROM customer
