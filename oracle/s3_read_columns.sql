-- standalone
SELECT o_orderkey, o_custkey FROM orders
