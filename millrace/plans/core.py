"""Queries of the relational core: scans, predicates, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import aggregates
from millrace.operators import relational
from millrace.plans.registry import query
from millrace.plans.sql import load, register

# Scans, projection, predicates
register("scan_project", "SELECT l_orderkey, l_quantity FROM {lineitem}")
register("scan_row_count", "SELECT count(*) AS n FROM {lineitem}")
register("one_row", "SELECT 0 AS zero", "SELECT CAST(0 AS INTEGER) AS zero")
register("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'no'), (3, CAST(NULL AS STRING))) AS t(i, s)", "SELECT * FROM (VALUES (1, 'a'), (2, 'no'), (3, CAST(NULL AS VARCHAR))) AS t(i, s)")
register("empty_relation", "SELECT n_nationkey, n_name FROM {nation} WHERE false")
register("index_search_point", "SELECT * FROM {orders} WHERE o_orderkey = 77")
register("index_search_range", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey BETWEEN 100 AND 200 OR o_orderkey > 1400 AND o_orderkey < 1410")
register("bitmap_and", "SELECT count(*) AS n FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 10")
register("bitmap_or", "SELECT count(*) AS n FROM {lineitem} WHERE l_returnflag = 'R' OR l_quantity > 45")
register("bitmap_minus", "SELECT o_orderkey FROM {orders} o LEFT ANTI JOIN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') d ON o.o_orderkey = d.l_orderkey", "SELECT o_orderkey FROM {orders} o ANTI JOIN (SELECT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') d ON o.o_orderkey = d.l_orderkey")
register("index_aggregate", "SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY l_returnflag")
register("bitmap_normalise", "SELECT n_nationkey, n_name FROM {nation} LATERAL VIEW explode(sequence(1, n_regionkey + 1)) t AS k", "SELECT n_nationkey, n_name FROM {nation}, unnest(range(1, n_regionkey + 2))")
register("uniqueness_check", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
register("filter_three_valued", "SELECT event_id FROM {events} WHERE (value > 10 AND NOT user_id = 3) OR event_type IS NULL")
register("truth_tests", "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS t, (c_acctbal > 0) IS NOT TRUE AS nt, (NULLIF(c_acctbal, c_acctbal) > 0) IS NULL AS u FROM {customer}")
register("is_distinct", "SELECT n_nationkey, NULLIF(n_regionkey, 1) IS NOT DISTINCT FROM NULLIF(n_nationkey, 1) AS same, NULLIF(n_regionkey, 1) IS DISTINCT FROM 2 AS other FROM {nation}")
register("in_list", "SELECT p_partkey FROM {part} WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size NOT IN (1, 2, 3)")
register("in_subquery", "SELECT count(*) AS n FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)")
register("not_in_subquery", "SELECT count(*) AS n FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)")
register("in_row_values", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, max(l_linenumber) FROM {lineitem} GROUP BY l_orderkey)")
register("like_escape", "SELECT p_name, p_name LIKE 'small%' AS a, p_name LIKE '_ed%' AS b, p_name NOT LIKE '%g' AS c, 'x_y' LIKE 'x!_y' ESCAPE '!' AS d FROM {part}")
register("exists_subquery", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
register("not_exists_subquery", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
register("case_expressions", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS c1, CASE p_type WHEN 'ECONOMY' THEN 1 ELSE 0 END AS c2, coalesce(NULLIF(p_size, 5), 0) AS c3 FROM {part}")
register("row_constructor", "SELECT r.a AS a, r.b AS b FROM (SELECT named_struct('a', n_nationkey, 'b', n_name) AS r FROM {nation}) t", "SELECT r.a AS a, r.b AS b FROM (SELECT {'a': n_nationkey, 'b': n_name} AS r FROM nation) t")

# Joins
register("join_inner", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
register("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM {nation}) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region}) y USING (k)")
register("join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name AS a FROM {nation}) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region}) y")
register("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
register("join_right", "SELECT n_name, s_name FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey")
register("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM {orders}) a FULL JOIN (SELECT c_custkey AS k FROM {customer} WHERE c_acctbal < 1000) b ON a.k = b.k")
register("join_semi", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM {customer} SEMI JOIN {orders} ON c_custkey = o_custkey")
register("join_anti", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM {customer} ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 400000")
register("join_cross", "SELECT n_name, r_name FROM {nation} CROSS JOIN {region}")
register("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
register("join_outer_theta", "SELECT r_name, count(n_name) AS n FROM {region} LEFT JOIN {nation} ON n_nationkey < r_regionkey * 2 GROUP BY r_name")
register("join_multi", "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {orders} ON c_custkey = o_custkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name")
register("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
register("star_semijoin", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_brand = 'Brand#2') AND l_suppkey IN (SELECT s_suppkey FROM {supplier} WHERE s_nationkey < 5)")
register("join_lateral", "SELECT r_name, t.n FROM {region}, LATERAL (SELECT count(*) AS n FROM {nation} WHERE n_regionkey = r_regionkey) t")
register("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS m FROM {customer}")


@query("SELECT n_nationkey, r_regionkey FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS x FROM nation) a JOIN (SELECT r_regionkey, NULLIF(r_regionkey, 1) AS y FROM region) b ON a.x IS NOT DISTINCT FROM b.y")
def join_null_safe(spark, sf_dir):
    a = load(spark, sf_dir, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("x"))
    b = load(spark, sf_dir, "region").select("r_regionkey", F.nullif("r_regionkey", F.lit(1)).alias("y"))
    return relational.null_safe_join(a, b, {"x": "y"}).select("n_nationkey", "r_regionkey")


@query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice / 100 >= p_retailprice AND o_totalprice / 100 < p_retailprice + 5")
def join_range_binned(spark, sf_dir):
    points = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    ranges = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 5).alias("high"))
    return relational.range_join(points, ranges, "at", "low", "high", 5.0).select("o_orderkey", "p_partkey")


@query("SELECT e.event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def join_as_of(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return relational.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", ["value"]).select("event_id", "last_value")


# Aggregates
register("agg_counts", "SELECT count(*) AS n, count(o_custkey) AS c, count(DISTINCT o_custkey) AS d, count(DISTINCT o_orderstatus, o_orderpriority) AS d2 FROM {orders}", "SELECT count(*) AS n, count(o_custkey) AS c, count(DISTINCT o_custkey) AS d, count(DISTINCT (o_orderstatus, o_orderpriority)) AS d2 FROM {orders}")
register("agg_basic", "SELECT l_suppkey, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM {lineitem} GROUP BY l_suppkey")
register("agg_deviation", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs FROM {lineitem} GROUP BY l_returnflag")
register("agg_distinct_mixed", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS sl, count(*) AS n FROM {lineitem} GROUP BY l_returnflag")
register("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, avg(l_quantity) AS a FROM {lineitem} WHERE l_quantity < 0")
register("agg_empty_grouped", "SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE l_quantity < 0 GROUP BY l_returnflag")
register("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
register("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
register("scalar_subquery", "SELECT n_name FROM {nation} WHERE n_nationkey = (SELECT max(s_nationkey) FROM {supplier})")
register("group_null_equal", "SELECT NULLIF(n_regionkey, 2) AS k, count(*) AS n FROM {nation} GROUP BY NULLIF(n_regionkey, 2)")
register("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
register("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
register("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("SELECT n_regionkey, CAST(sum(n_nationkey) AS INTEGER) AS s, CAST(coalesce(sum(CASE WHEN n_nationkey < 0 THEN 1 END), 0) AS BIGINT) AS z FROM nation GROUP BY n_regionkey")
def agg_argument_typed(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(aggregates.ref_sum(F.col("n_nationkey"), "int").alias("s"), aggregates.sum0(F.when(F.col("n_nationkey") < 0, 1)).alias("z"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def agg_salted(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return relational.skewed_agg(li, ["l_returnflag"], F.col("l_orderkey"), 16, {"s": F.sum("l_quantity"), "n": F.count(F.lit(1))}, {"s": F.round(F.sum("s"), 2), "n": F.sum("n")})


# Windows
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
register("window_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, round(avg(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM {{orders}}")
register("window_running", f"SELECT o_orderkey, min(o_totalprice) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS lo, max(o_totalprice) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS hi, first_value(o_orderkey) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l FROM {{orders}}")
register("window_range_number", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM {part}")
register("window_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM {orders}")
register("window_named", f"SELECT o_orderkey, count(*) OVER w AS n, round(avg(o_totalprice) OVER w, 4) AS a FROM {{orders}} WINDOW w AS ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
register("window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS n FROM {orders}")
register("window_lead_lag", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS p, lead(o_orderkey, 2) OVER ({_W}) AS q, CAST(ntile(3) OVER ({_W}) AS BIGINT) AS t FROM {{orders}}")
register("window_no_order", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n, max(n_name) OVER (PARTITION BY n_regionkey) AS m FROM {nation}")


@query(f"SELECT o_orderkey, CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN round(sum(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) END AS s FROM orders")
def window_disallow_partial(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(aggregates.full_frame(F.sum("o_totalprice"), w, 3), 2).alias("s"))


# Sorts and limits
register("sort_nulls_low", "SELECT k FROM (SELECT NULLIF(n_nationkey, 3) AS k FROM {nation}) t ORDER BY k", "SELECT k FROM (SELECT NULLIF(n_nationkey, 3) AS k FROM {nation}) t ORDER BY k NULLS FIRST")
register("sort_desc_limit", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
register("sort_offset", "SELECT c_custkey FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20")
register("sort_ordinal", "SELECT n_regionkey, n_name FROM {nation} ORDER BY 1, 2 DESC")

# Set operations
_A, _C = "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O'"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect_distinct", "INTERSECT"), ("except_distinct", "EXCEPT"), ("intersect_all", "INTERSECT ALL"), ("except_all", "EXCEPT ALL")):
    register(f"set_{_name}", f"{_A} {_op} {_C}")
register("set_precedence", f"{_A} UNION SELECT c_custkey AS k FROM {{customer}} WHERE c_acctbal < 0 INTERSECT {_C}")
register("set_null_equal", "SELECT NULLIF(n_regionkey, 1) AS k FROM {nation} INTERSECT SELECT NULLIF(r_regionkey, 1) AS k FROM {region}")


# Sampling: what holds for any sample
@query("SELECT true AS near, true AS part_of FROM orders LIMIT 1")
def sample_tablesample(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    n = spark.sql("SELECT o_orderkey FROM {t} TABLESAMPLE (20 PERCENT) REPEATABLE (7)", t=o).agg(F.count(F.lit(1)).alias("n"))
    both = n.crossJoin(o.agg(F.count(F.lit(1)).alias("m")))  # two rows of counts
    return both.select((F.abs(F.col("n") - 0.2 * F.col("m")) < 5 * F.sqrt(0.16 * F.col("m"))).alias("near"), (F.col("n") <= F.col("m")).alias("part_of"))
