"""Queries of the function families, and of the table functions, DML, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import datetimes as D
from millrace.functions import numerics as N
from millrace.functions import strings as S
from millrace.operators import dml, relational
from millrace.operators import table_functions as T
from millrace.plans.registry import query
from millrace.plans.sql import load, register

# Strings
register("string_core", "SELECT p_partkey, p_name || '/' || p_brand AS cat, substring(p_name, 2, 3) AS sub, position('i' IN p_name) AS pos, upper(p_name) AS u, lower(p_brand) AS l, char_length(p_name) AS n, octet_length(encode(p_name, 'UTF-8')) AS o FROM {part}", "SELECT p_partkey, p_name || '/' || p_brand AS cat, substring(p_name, 2, 3) AS sub, CAST(position('i' IN p_name) AS INTEGER) AS pos, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INTEGER) AS n, CAST(octet_length(encode(p_name)) AS INTEGER) AS o FROM {part}")
register("string_trim", "SELECT p_partkey, trim(BOTH 's' FROM p_name) AS b, trim(LEADING 's' FROM p_name) AS l, trim(TRAILING 'g' FROM p_name) AS t, ltrim('  x ') AS x FROM {part}", "SELECT p_partkey, trim(p_name, 's') AS b, ltrim(p_name, 's') AS l, rtrim(p_name, 'g') AS t, ltrim('  x ') AS x FROM {part}")
register("string_overlay", "SELECT p_partkey, overlay(p_name PLACING 'XX' FROM 2 FOR 3) AS o, translate(p_name, 'aei', 'AE') AS t FROM {part}", "SELECT p_partkey, left(p_name, 1) || 'XX' || substring(p_name, 5) AS o, translate(p_name, 'aei', 'AE') AS t FROM {part}")


@query("SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, repeat(p_brand, 2) AS rep, replace(p_name, 'ring', 'RING') AS sr, translate(p_name, 'r', 'R') AS cr, regexp_matches(p_brand, '[0-9]') AS d, CAST(instr(p_name, 'i') AS INTEGER) AS i FROM part")
def string_applib(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    return load(spark, sf_dir, "part").select("p_partkey", S.left_n(n, F.lit(4)).alias("l"), S.right_n(n, F.lit(3)).alias("r"), S.repeater(b, F.lit(2)).alias("rep"), S.str_replace(n, F.lit("ring"), F.lit("RING")).alias("sr"), S.char_replace(n, "r", "R").alias("cr"), S.contains_number(b).alias("d"), S.instr(n, F.lit("i")).alias("i"))


@query("SELECT p_partkey, regexp_matches(p_name, '^(?:(small|red).*)$') AS a, regexp_matches(p_brand, '^(?:Brand#[0-9]+)$') AS b FROM part")
def similar_to(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", S.similar_to(F.col("p_name"), "(small|red)%").alias("a"), S.similar_to(F.col("p_brand"), "Brand#[0-9]+").alias("b"))


@query("SELECT count(*) AS n FROM part WHERE rtrim(p_type || '  ') = rtrim('ECONOMY ')")
def equal_padded(spark, sf_dir):
    return load(spark, sf_dir, "part").where(S.eq_padded(F.concat("p_type", F.lit("  ")), F.lit("ECONOMY "))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) AS phone FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 2000000000 AS VARCHAR), 10, '2') AS d FROM customer)")
def clean_phone(spark, sf_dir):
    d = F.lpad((F.col("c_custkey") * 7919 + 2000000000).cast("string"), 10, "2")
    return load(spark, sf_dir, "customer").select("c_custkey", S.clean_phone(F.concat_ws(".", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))).alias("phone"))


# Dates
register("date_extract", "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, extract(DAY FROM o_orderdate) AS d, extract(HOUR FROM o_orderdate) AS h FROM {orders}", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(extract(MONTH FROM o_orderdate) AS INTEGER) AS m, CAST(extract(DAY FROM o_orderdate) AS INTEGER) AS d, CAST(extract(HOUR FROM o_orderdate) AS INTEGER) AS h FROM {orders}")
register("date_interval", "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS a, o_orderdate - INTERVAL '1' MONTH AS b FROM {orders}")
register("date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS s, to_date('02/03/2001', 'dd/MM/yyyy') AS d FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS s, DATE '2001-03-02' AS d FROM {orders}")


@query("""SELECT o_orderkey, 'Q' || quarter(o_orderdate) || 'CY' || strftime(o_orderdate, '%y') AS cq, CAST((month(o_orderdate) - 4 + 12) % 12 + 1 AS INTEGER) AS fm,
 CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS INTEGER) AS fy,
 'Q' || CAST(((month(o_orderdate) - 4 + 12) % 12) // 3 + 1 AS INTEGER) || 'FY' || lpad(CAST((year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') AS fq,
 CAST(dayofyear(o_orderdate) AS INTEGER) AS dy, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS dn, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' + 2440588 AS INTEGER) AS jd FROM orders""")
def date_fiscal(spark, sf_dir):
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", D.calendar_quarter(d).alias("cq"), D.fiscal_month(d, 4).alias("fm"), D.fiscal_year(d, 4).alias("fy"), D.fiscal_quarter(d, 4).alias("fq"), D.day_in_year(d).alias("dy"), D.day_number_overall(d).alias("dn"), D.julian_day(d).alias("jd"))


@query("SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('week', ts) AS w, CAST(month(ts) - 1 AS INTEGER) AS m, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow FROM events")
def date_truncate(spark, sf_dir):
    t = F.col("ts")
    return load(spark, sf_dir, "events").select("event_id", D.truncate_timestamp(t, "HOURLY").alias("h"), D.truncate_timestamp(t, "WEEKLY").alias("w"), D.extract_timestamp(t, "MONTH").alias("m"), D.extract_timestamp(t, "DOW").alias("dow"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 5 AS a, date_diff('day', TIMESTAMP '1997-01-01 00:00:00', o_orderdate) AS d, lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS w FROM orders")
def date_arithmetic(spark, sf_dir):
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", D.add_days(d, F.lit(5)).alias("a"), D.days_diff(d, F.lit("1997-01-01").cast("date")).cast("long").alias("d"), D.pad_week_number(F.weekofyear(d)).alias("w"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CAST('2001-02-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS DATE) END AS d FROM nation")
def convert_date(spark, sf_dir):
    day = F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(day, F.lit("/02/2001"))).otherwise(F.lit("not a date"))
    return load(spark, sf_dir, "nation").select("n_nationkey", D.convert_date(text, "DD/MM/YYYY").alias("d"))


@query("SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a, orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate < b.o_orderdate + INTERVAL 10 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 10 DAY")
def period_overlaps(spark, sf_dir):
    """Orders of a customer whose periods of ten days overlap: an equi-join by customer, then OVERLAPS."""
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL '10' DAY")).alias("e"))
    both = o.alias("a").join(o.alias("b"), F.expr("a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"))
    return both.where(D.overlaps(F.col("a.s"), F.col("a.e"), F.col("b.s"), F.col("b.e"))).select(F.col("a.o_orderkey").alias("x"), F.col("b.o_orderkey").alias("y"))


@query("SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a, part b WHERE a.p_partkey < b.p_partkey AND a.p_retailprice < b.p_retailprice + 0.5 AND b.p_retailprice < a.p_retailprice + 0.5")
def period_overlaps_binned(spark, sf_dir):
    """Intervals without another key: by bins instead of all pairs."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("s"), (F.col("p_retailprice") + 0.5).alias("e"))
    return relational.overlap_pairs(p, "p_partkey", "s", "e", 0.5)


# Numbers
register("math_core", "SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, round(power(p_size, 2), 6) AS p, round(sqrt(p_size), 6) AS q, round(exp(p_size / 10.0), 4) AS e, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c FROM {part}")


@query("SELECT p_partkey, CAST(round(CAST(p_size AS DOUBLE) / 7, 6) AS DOUBLE) AS q, p_size // 7 AS d, CAST(round(p_retailprice) AS INTEGER) AS i, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS g, CAST(round(p_retailprice * 100) AS BIGINT) AS r FROM part")
def math_exact(spark, sf_dir):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return load(spark, sf_dir, "part").select("p_partkey", N.quotient(s, F.lit(7)).cast("double").alias("q"), N.int_div(s, F.lit(7)).cast("int").alias("d"), N.to_integer(p).alias("i"), F.round(N.ln(s), 6).alias("l"), F.round(N.log10(s), 6).alias("g"), N.reinterpret(p, 2).alias("r"))


# Multisets
@query("SELECT n_regionkey, list_sort(list(n_nationkey)) AS m FROM nation GROUP BY n_regionkey")
def collect_multiset(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("m"))


@query("SELECT n_regionkey, unnest(list(n_name)) AS name FROM nation GROUP BY n_regionkey")
def unnest_multiset(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("m")).select("n_regionkey", F.explode("m").alias("name"))


# Table functions
@query("SELECT n_regionkey AS parent_value, string_agg(n_name, ',' ORDER BY n_nationkey) AS concatenated_child_values, count(n_name) AS collapsed_row_count FROM (SELECT n_regionkey, n_nationkey, NULLIF(n_name, 'FRANCE') AS n_name FROM nation) GROUP BY n_regionkey")
def collapse_rows(spark, sf_dir):
    n = load(spark, sf_dir, "nation").withColumn("n_name", F.nullif("n_name", F.lit("FRANCE")))
    return T.collapse_rows(n, "n_regionkey", "n_name", ["n_nationkey"], ",")


@query("SELECT o_orderkey, 10 + 5 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS seq FROM orders")
def generate_sequence(spark, sf_dir):
    return T.generate_sequence(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 10, 5).select("o_orderkey", "seq")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS seq FROM orders")
def generate_sequence_global(spark, sf_dir):
    return T.generate_sequence(load(spark, sf_dir, "orders"), [], ["o_totalprice", "o_orderkey"]).select("o_orderkey", "seq")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def top_n(spark, sf_dir):
    return T.top_n(load(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 7).select("o_orderkey")


@query("UNPIVOT (SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation WHERE n_nationkey = 7) ON n_nationkey, n_name, n_regionkey INTO NAME param_name VALUE param_value")
def pivot_columns_to_rows(spark, sf_dir):
    return T.pivot_columns_to_rows(load(spark, sf_dir, "nation").where("n_nationkey = 7"))


@query("""WITH RECURSIVE e AS (SELECT CASE WHEN n_nationkey = 0 THEN NULL ELSE CAST(n_nationkey // 3 AS VARCHAR) END AS p, CAST(n_nationkey AS VARCHAR) AS c FROM nation WHERE n_nationkey <> 0 OR true),
w AS (SELECT [c] AS path, c AS l FROM e WHERE p IS NULL UNION ALL SELECT list_append(path, e.c), e.c FROM w JOIN e ON e.p = w.l)
SELECT CAST(len(path) AS INTEGER) AS vertex_count, path[1] AS level1, coalesce(path[2], l) AS level2, coalesce(path[3], l) AS level3, coalesce(path[4], l) AS level4 FROM w WHERE l NOT IN (SELECT p FROM e WHERE p IS NOT NULL)""")
def flatten_hierarchy(spark, sf_dir):
    k = F.col("n_nationkey")
    e = load(spark, sf_dir, "nation").select(F.when(k > 0, F.floor(k / 3).cast("string")).alias("p"), k.cast("string").alias("c"))
    return T.flatten_hierarchy(e, "p", "c").select("vertex_count", "level1", "level2", "level3", "level4")


_E = "(SELECT user_id, ts, event_type FROM events)"


@query(f"""WITH f AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, event_type FROM f WHERE rn = 1 OR prev IS DISTINCT FROM event_type)
SELECT user_id, ts AS from_timestamp, event_type, lead(ts) OVER w AS until_timestamp, lag(event_type) OVER w AS previous_clump, lag(ts) OVER w AS previous_from, lead(event_type) OVER w AS next_clump, lead(ts, 2) OVER w AS next_until FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def contiguous_intervals(spark, sf_dir):
    return T.contiguous_intervals(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_type")


@query("""WITH f AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT user_id, ts, prev, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM f WHERE rn > 1 AND prev IS DISTINCT FROM event_type),
u AS (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id)
SELECT u.user_id, coalesce(b.ts, u.first) AS ts, a.prev AS event_type, coalesce(a.ts, u.first) AS until_timestamp FROM u LEFT JOIN c a ON a.user_id = u.user_id AND a.k = 1 LEFT JOIN c b ON b.user_id = u.user_id AND b.k = 2""")
def penultimate_values(spark, sf_dir):
    return T.penultimate_values(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", [])


@query("SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) - INTERVAL '1' SECOND AS effective_to_timestamp FROM events")
def effective_to(spark, sf_dir):
    return T.effective_to(load(spark, sf_dir, "events"), ["user_id"], "ts", 1.0).select("event_id", "effective_to_timestamp")


@query("SELECT p_partkey, t AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) WHERE t <> ''")
def split_rows(spark, sf_dir):
    return T.split_rows(load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("word")), "word", " ", "\\")


@query("SELECT p_partkey FROM part WHERE p_size <= 40")
def enforce_constraints(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("code", F.when(F.col("p_size") > 40, "TOO_BIG").when(F.col("p_size") > 30, "BIG"))
    return T.enforce_constraints(p, ["code"], {"TOO_BIG": "reject", "BIG": "warning"})[0].select("p_partkey")


@query("""SELECT CAST(d AS DATE) AS time_key, strftime(d, '%A') AS day_of_week, dayofweek(d) IN (0, 6) AS is_weekend, CAST(CAST(d AS DATE) - CAST(dayofweek(d) AS INTEGER) AS DATE) AS week_start, last_day(d) AS month_end, CAST(quarter(d) AS INTEGER) AS quarter, CAST((month(d) - 10 + 12) % 12 + 1 AS INTEGER) AS fiscal_month
FROM range(TIMESTAMP '1999-12-25 00:00:00', TIMESTAMP '2001-01-06 00:00:00', INTERVAL 1 DAY) t(d)""")
def time_dimension(spark, sf_dir):
    return T.time_dimension(spark, "1999-12-25", "2001-01-05", 10).select("time_key", "day_of_week", "is_weekend", "week_start", "month_end", "quarter", "fiscal_month")


@query("SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS distinct_count FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders HAVING 100 * count(DISTINCT o_custkey) <= 12 * count(*)")
def index_candidates(spark, sf_dir):
    """Columns of few values, counted exactly."""
    return T.index_candidates(load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey"), 12)


@query("""WITH f AS (SELECT user_id, ts, event_type, value, lag(event_type) OVER w AS pe, lag(value) OVER w AS pv, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
e AS (SELECT user_id, pe FROM f WHERE rn > 1 AND pe IS DISTINCT FROM event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
v AS (SELECT user_id, pv FROM f WHERE rn > 1 AND pv IS DISTINCT FROM value QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, e.pe AS event_type, v.pv AS value FROM u LEFT JOIN e ON e.user_id = u.user_id LEFT JOIN v ON v.user_id = u.user_id""")
def penultimate_values_others(spark, sf_dir):
    """Another column beside the designated one."""
    return T.penultimate_values(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", ["value"]).select("user_id", "event_type", "value")


@query("""WITH r AS (SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation),
g AS (SELECT *, n - row_number() OVER (PARTITION BY n_regionkey ORDER BY n) AS run FROM r)
SELECT min(n) AS start, n_regionkey AS parent_value, string_agg(n_name, '/' ORDER BY n) AS concatenated_child_values, count(n_name) AS collapsed_row_count FROM g GROUP BY n_regionkey, run""")
def collapse_runs(spark, sf_dir):
    """A parent that comes back later begins a new row."""
    return T.collapse_runs(load(spark, sf_dir, "nation"), "n_regionkey", "n_name", ["n_nationkey"], "/")


# DML: the state after a statement
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT n_regionkey = 2")
def dml_delete(spark, sf_dir):
    return dml.deleted(load(spark, sf_dir, "nation"), F.col("n_regionkey") == 2)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper('x' || n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update(spark, sf_dir):
    return dml.updated(load(spark, sf_dir, "nation"), F.col("n_regionkey") == 1, {"n_name": F.upper(F.concat(F.lit("x"), "n_name"))})


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, c_acctbal + 1 FROM customer WHERE c_custkey % 5 = 0")
def dml_merge(spark, sf_dir):
    t = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = F.col("c_acctbal") + 1
    source = t.where("c_custkey % 3 = 0").select("c_custkey", new.alias("c_acctbal")).union(t.where("c_custkey % 5 = 0").select(F.col("c_custkey") + 10000000, new))
    return dml.merged(t, source, ["c_custkey"])


# Streams (the engine is a batch engine; windows over event time are an addition)
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


