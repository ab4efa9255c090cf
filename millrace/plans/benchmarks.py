"""Benchmark queries: TPC-H shapes on the tables at hand, star-schema shapes, set-query and group-by shapes."""

from __future__ import annotations

from millrace.plans.sql import register

REV = "l_extendedprice * (1 - l_discount)"
#: Sums of money are exact: products of prices and rates have four decimals.
SUM = f"CAST(round(sum(CAST({REV} AS DECIMAL(18, 4))), 2) AS DOUBLE)"

register("tpch_q1", f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  {SUM} AS sum_disc_price, round(sum({REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
  round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
register("tpch_q3", f"""
SELECT l_orderkey, {SUM} AS revenue, o_orderdate
FROM {{customer}}, {{orders}}, {{lineitem}}
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
register("tpch_q4_shape", """
SELECT o_orderpriority, count(*) AS order_count FROM {orders} o
WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate)
GROUP BY o_orderpriority""")
register("tpch_q5", f"""
SELECT n_name, {SUM} AS revenue
FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""")
register("tpch_q6", """
SELECT CAST(round(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))), 2) AS DOUBLE) AS revenue FROM {lineitem}
WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
register("tpch_q7_shape", f"""
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {SUM} AS revenue
FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2
WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey
  AND c_nationkey = n2.n_nationkey AND n1.n_nationkey < n2.n_nationkey AND n2.n_nationkey < 6 GROUP BY 1, 2, 3""")
register("tpch_q10", f"""
SELECT c_custkey, c_name, {SUM} AS revenue, c_acctbal, n_name
FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
register("tpch_q12_shape", """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey GROUP BY l_linestatus""")
register("tpch_q13_shape", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY c_count""")
register("tpch_q14_shape", f"""
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END) / sum({REV}), 4) AS promo_revenue
FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey""")
register("tpch_q15_shape", f"""
WITH r AS (SELECT l_suppkey, {SUM} AS total FROM {{lineitem}} GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total FROM {{supplier}}, r WHERE s_suppkey = l_suppkey AND total = (SELECT max(total) FROM r)""")
register("tpch_q17_shape", """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} l, {part}
WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM {lineitem} x WHERE x.l_partkey = p_partkey)""")
register("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM {customer}, {orders}, {lineitem}
WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 180) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice""")
register("tpch_q19_shape", f"""
SELECT {SUM} AS revenue FROM {{lineitem}}, {{part}}
WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
  OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30))""")
register("tpch_q22_shape", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM {customer} c
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey) GROUP BY c_nationkey""")

for _n, _where in enumerate((
    "o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25",
    "o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-02-01 00:00:00' AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35",
    "o_orderdate >= TIMESTAMP '1998-04-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-07-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 36 AND 40",
), 1):
    register(f"ssb_q1_{_n}", f"SELECT CAST(round(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))), 2) AS DOUBLE) AS revenue FROM {{lineitem}}, {{orders}} WHERE l_orderkey = o_orderkey AND {_where}")
for _n, _where in enumerate(("p_type = 'ECONOMY' AND r_name = 'AMERICA'", "p_brand BETWEEN 'Brand#10' AND 'Brand#14' AND r_name = 'ASIA'", "p_brand = 'Brand#17' AND r_name = 'EUROPE'"), 1):
    register(f"ssb_q2_{_n}", f"SELECT CAST(year(o_orderdate) AS BIGINT) AS d_year, p_brand, {SUM} AS revenue FROM {{lineitem}}, {{orders}}, {{part}}, {{supplier}}, {{nation}}, {{region}} WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND {_where} GROUP BY 1, p_brand")
for _n, (_keys, _where) in enumerate((("cn.n_name AS c_nation, sn.n_name AS s_nation", "cr.r_name = 'ASIA' AND sr.r_name = 'ASIA'"), ("c_name, s_name", "cn.n_nationkey = 3 AND sn.n_nationkey = 3"), ("c_mktsegment, sn.n_name AS s_nation", "cr.r_name = 'EUROPE' AND sr.r_name = 'AMERICA'"), ("cn.n_name AS c_nation, s_name", "cr.r_name = 'AFRICA' AND o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'")), 1):
    register(f"ssb_q3_{_n}", f"SELECT {_keys}, CAST(year(o_orderdate) AS BIGINT) AS d_year, {SUM} AS revenue FROM {{lineitem}}, {{orders}}, {{customer}}, {{supplier}}, {{nation}} cn, {{nation}} sn, {{region}} cr, {{region}} sr WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND {_where} GROUP BY 1, 2, 3")
for _n, (_key, _where) in enumerate((("n_name", "r_name = 'AMERICA'"), ("p_type", "r_name = 'AMERICA' AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'"), ("p_brand", "n_nationkey = 7 AND p_type = 'ECONOMY'")), 1):
    register(f"ssb_q4_{_n}", f"SELECT CAST(year(o_orderdate) AS BIGINT) AS d_year, {_key}, CAST(round(sum(CAST({REV} - 0.5 * p_retailprice AS DECIMAL(18, 4))), 2) AS DOUBLE) AS profit FROM {{lineitem}}, {{orders}}, {{part}}, {{supplier}}, {{nation}}, {{region}} WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND {_where} GROUP BY 1, 2")

_B = "(SELECT l_orderkey * 8 + l_linenumber AS kseq, l_orderkey % 2 AS k2, l_partkey % 4 AS k4, l_suppkey % 5 AS k5, l_partkey % 10 AS k10, l_suppkey % 25 AS k25, l_partkey % 100 AS k100, l_orderkey % 1000 AS k1k FROM {lineitem})"
register("sqbm_q1", f"SELECT count(*) AS n FROM {_B} b WHERE k10 = 2")
register("sqbm_q2a", f"SELECT count(*) AS n FROM {_B} b WHERE k2 = 1 AND k100 = 3")
register("sqbm_q2b", f"SELECT count(*) AS n FROM {_B} b WHERE k2 = 1 AND NOT k100 = 3")
register("sqbm_q3a", f"SELECT CAST(sum(k1k) AS BIGINT) AS s FROM {_B} b WHERE kseq BETWEEN 40000 AND 50000 AND k100 = 3")
register("sqbm_q3b", f"SELECT CAST(sum(k1k) AS BIGINT) AS s FROM {_B} b WHERE (kseq BETWEEN 4000 AND 4100 OR kseq BETWEEN 4200 AND 4300 OR kseq BETWEEN 44200 AND 48500) AND k10 = 3")
register("sqbm_q4", f"SELECT kseq, k1k FROM {_B} b WHERE k2 = 1 AND k4 = 3 AND k5 < 3 AND k10 > 2 AND k25 IN (11, 19)")
register("sqbm_q5", f"SELECT k2, k100, count(*) AS n FROM {_B} b GROUP BY k2, k100")
register("sqbm_q6a", f"SELECT count(*) AS n FROM {_B} b1, {_B} b2 WHERE b1.k100 = 49 AND b1.k1k = b2.kseq")
register("sqbm_q6b", f"SELECT b1.kseq, b2.kseq AS kseq2 FROM {_B} b1, {_B} b2 WHERE b1.k100 = 99 AND b1.k1k = b2.kseq AND b2.k25 = 19")
register("sqbm_join_swing", f"SELECT max(b1.kseq) AS m FROM {_B} b1, {_B} b2 WHERE b1.kseq = b2.kseq AND b2.k5 = 3")
for _k in ("k2", "k4", "k10", "k25"):
    register(f"groupby_{_k}", f"SELECT {_k}, CAST(sum(k1k) AS BIGINT) AS s, min(k1k) AS lo, max(k1k) AS hi, count(*) AS n FROM {_B} b GROUP BY {_k}")
register("drill_facts", "SELECT n_name, c_mktsegment, CAST(year(o_orderdate) AS BIGINT) AS y, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS sales FROM {orders}, {customer}, {nation} WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY 1, 2, 3")
register("tpch_q8_shape", """
SELECT year(o_orderdate) AS o_year, round(sum(CASE WHEN sn.n_name = cn.n_name THEN l_extendedprice ELSE 0 END), 2) AS own, round(sum(l_extendedprice), 2) AS volume
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} sn ON s_nationkey = sn.n_nationkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {region} ON cn.n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND p_size < 25 GROUP BY year(o_orderdate)""", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(CASE WHEN sn.n_name = cn.n_name THEN l_extendedprice ELSE 0 END), 2) AS own, round(sum(l_extendedprice), 2) AS volume
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND p_size < 25 GROUP BY year(o_orderdate)""")
register("tpch_q21_shape", """
SELECT s_name, count(*) AS numwait FROM {supplier} JOIN {lineitem} a ON s_suppkey = a.l_suppkey JOIN {orders} ON o_orderkey = a.l_orderkey
WHERE o_orderstatus = 'F' AND a.l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM {lineitem} b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM {lineitem} c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R')
GROUP BY s_name""")

#: Offers of parts by suppliers, which the tables have no list of: what was sold, with the lowest unit price as cost.
_PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(floor(min(l_extendedprice / l_quantity)) AS DECIMAL(12, 2)) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM {lineitem} GROUP BY l_partkey, l_suppkey)"
register("tpch_q2_shape", f"""
WITH ps AS {_PS}, o AS (SELECT ps_partkey, s_suppkey, s_name, n_name, ps_supplycost FROM ps, {{supplier}}, {{nation}}, {{region}} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
SELECT s_name, n_name, p_partkey, p_brand FROM {{part}}, o WHERE p_partkey = ps_partkey AND p_size < 15
  AND ps_supplycost = (SELECT min(x.ps_supplycost) FROM o x WHERE x.ps_partkey = p_partkey)""")
register("tpch_q9_shape", f"""
WITH ps AS {_PS}
SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS o_year, CAST(round(sum(CAST({REV} AS DECIMAL(18, 4)) - ps_supplycost * CAST(l_quantity AS DECIMAL(12, 2))), 2) AS DOUBLE) AS sum_profit
FROM {{part}}, {{supplier}}, {{lineitem}}, ps, {{orders}}, {{nation}}
WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
  AND s_nationkey = n_nationkey AND p_name LIKE '%re%' GROUP BY 1, 2""")
register("tpch_q11_shape", f"""
WITH ps AS {_PS}, v AS (SELECT ps_partkey, CAST(ps_supplycost * ps_availqty AS DECIMAL(24, 4)) AS value FROM ps, {{supplier}} WHERE ps_suppkey = s_suppkey AND s_nationkey < 13)
SELECT ps_partkey, CAST(round(sum(value), 2) AS DOUBLE) AS value FROM v GROUP BY ps_partkey HAVING sum(value) > (SELECT sum(value) * 0.0012 FROM v)""")
register("tpch_q16_shape", f"""
WITH ps AS {_PS}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, {{part}}
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""")
register("tpch_q20_shape", f"""
WITH ps AS {_PS}
SELECT s_name FROM {{supplier}}, {{nation}} WHERE s_nationkey = n_nationkey AND n_regionkey < 3 AND s_suppkey IN (
  SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_name LIKE 's%')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {{lineitem}} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'))""")
