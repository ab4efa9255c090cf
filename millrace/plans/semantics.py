"""Queries of casts, string, date, numeric and context functions, bitmap indexes, frames and errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import aggregates as A
from millrace.functions import collections as C
from millrace.functions import context as X
from millrace.functions import datetimes as D
from millrace.functions import numerics as N
from millrace.functions import strings as S
from millrace.operators import bitmaps, procedures, relational
from millrace.operators import table_functions as T
from millrace.plans.registry import query
from millrace.plans.sql import load, register

# Parameters, predicates


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2 AND n_name > 'C'")
def dynamic_parameter(spark, sf_dir):
    """Values are bound to the plan, not put into the text."""
    return spark.sql("SELECT n_name, n_regionkey FROM {nation} WHERE n_regionkey = ? AND n_name > ?", args=[2, "C"], nation=load(spark, sf_dir, "nation"))


@query("SELECT n_name FROM nation WHERE n_regionkey = 3")
def dynamic_parameter_named(spark, sf_dir):
    return spark.sql("SELECT n_name FROM {nation} WHERE n_regionkey = :region", args={"region": 3}, nation=load(spark, sf_dir, "nation"))


@query("SELECT p_partkey, (p_size >= least(50 - p_size, p_partkey % 50) AND p_size <= greatest(50 - p_size, p_partkey % 50)) AS inside FROM part")
def between_symmetric(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", X.between_symmetric(s, 50 - s, k % 50).alias("inside"))


register("between_asymmetric", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 50 - p_size AND p_partkey % 50")
register("index_only_scan", "SELECT DISTINCT l_suppkey FROM {lineitem} WHERE l_suppkey > 5")
register("regex_match", "SELECT p_partkey, p_name RLIKE '^[a-m].*g$' AS hit FROM {part}", "SELECT p_partkey, regexp_matches(p_name, '^[a-m].*g$') AS hit FROM part")

# Casts
register("cast_text_to_number", "SELECT o_orderkey, CAST(CAST(o_orderkey AS STRING) AS INT) AS i, CAST(CAST(o_totalprice AS STRING) AS DOUBLE) AS d, CAST(CAST(o_orderkey % 100 AS STRING) AS SMALLINT) AS s FROM {orders}", "SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS i, o_totalprice AS d, CAST(o_orderkey % 100 AS SMALLINT) AS s FROM orders")
register("cast_number_to_text", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS STRING) AS a, CAST(CAST(l_quantity AS DECIMAL(10, 2)) AS STRING) AS b, CAST(l_quantity > 25 AS STRING) AS c FROM {lineitem}", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS a, CAST(CAST(l_quantity AS DECIMAL(10, 2)) AS VARCHAR) AS b, CAST(l_quantity > 25 AS VARCHAR) AS c FROM lineitem")
register("cast_text_to_date", "SELECT o_orderkey, CAST(date_format(o_orderdate, 'yyyy-MM-dd') AS DATE) AS d, CAST(date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ) AS t FROM {orders}", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, date_trunc('second', o_orderdate) AS t FROM orders")
register("cast_date_to_text", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS s, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ) AS t FROM {orders}", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS s, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS t FROM orders")
register("cast_interval", "SELECT o_orderkey, o_orderdate + CAST('3' AS INTERVAL DAY) AS a, CAST(INTERVAL '50' HOUR AS INT) AS h FROM {orders}", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, 50 AS h FROM orders")
register("cast_boolean", "SELECT n_nationkey, CAST(n_regionkey AS BOOLEAN) AS b, CAST(CASE WHEN n_regionkey > 2 THEN 'true' ELSE 'FALSE' END AS BOOLEAN) AS t FROM {nation}", "SELECT n_nationkey, n_regionkey <> 0 AS b, n_regionkey > 2 AS t FROM nation")
register("cast_null", "SELECT n_nationkey, CAST(NULL AS INT) AS i, CAST(NULLIF(CAST(n_regionkey AS STRING), '1') AS INT) AS r FROM {nation}", "SELECT n_nationkey, CAST(NULL AS INTEGER) AS i, NULLIF(n_regionkey, 1) AS r FROM nation")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) AS i, CAST(round(-l_extendedprice) AS BIGINT) AS j, CAST(round(l_quantity * 1.5) AS INTEGER) AS k FROM lineitem")
def cast_rounds(spark, sf_dir):
    p = F.col("l_extendedprice")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.to_integer(p, "bigint").alias("i"), N.to_integer(-p, "bigint").alias("j"), X.cast_text((F.col("l_quantity") * 1.5).cast("string"), "int").alias("k"))


@query("SELECT p_partkey, rpad(substr(p_name, 1, 8), 8, ' ') AS c, substr(p_name, 1, 5) AS v, rpad(CAST(p_size AS VARCHAR), 4, ' ') AS n FROM part")
def cast_char(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", X.cast_char(F.col("p_name"), 8).alias("c"), X.cast_char(F.col("p_name"), 5, False).alias("v"), X.cast_char(F.col("p_size"), 4).alias("n"))


def _cases(spark, cases: dict[str, str]):
    """(name, raised): whether evaluating or only analysing each statement fails. Statements are a fixed few."""
    rows = []
    for name, text in cases.items():
        try:
            spark.sql(text).collect()
            rows.append((name, False))
        except Exception:  # noqa: BLE001 any error is what is asked for
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, raised boolean")


def _expected(raised: list[str], fine: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(n in raised).lower()})" for n in raised + fine) + ") t(name, raised)"


@query(_expected(["text", "tinyint", "smallint", "int", "date", "decimal"], ["fits"]))
def cast_errors(spark, sf_dir):
    return _cases(spark, {"text": "SELECT CAST('x1' AS INT)", "tinyint": "SELECT CAST(128 AS TINYINT)", "smallint": "SELECT CAST(40000 AS SMALLINT)", "int": "SELECT CAST(3000000000 AS INT)", "date": "SELECT CAST('2001-13-01' AS DATE)", "decimal": "SELECT CAST(12345 AS DECIMAL(4, 1))", "fits": "SELECT CAST('127' AS TINYINT)"})


@query(_expected(["add", "multiply", "negate", "divide", "modulo", "raise"], ["fits"]))
def checked_arithmetic(spark, sf_dir):
    return _cases(spark, {"add": "SELECT 2147483647 + CAST(1 AS INT)", "multiply": "SELECT 9223372036854775807L * 2L", "negate": "SELECT -CAST(-2147483648 AS INT)", "divide": "SELECT 1 / 0", "modulo": "SELECT 1 % 0", "raise": "SELECT raise_error('stop')", "fits": "SELECT 2147483647L + 1L"})


@query(_expected(["no_order", "reversed", "range_two_keys"], ["fine"]))
def window_frame_errors(spark, sf_dir):
    over = "SELECT sum(x) OVER (%s) FROM VALUES (1, 2) t(x, y)"
    found = _cases(spark, {"no_order": "SELECT rank() OVER (PARTITION BY x) FROM VALUES (1, 2) t(x, y)", "range_two_keys": over % "ORDER BY x, y RANGE BETWEEN 1 PRECEDING AND CURRENT ROW", "fine": over % "ORDER BY x ROWS 2 PRECEDING"})
    try:
        A.frame(Window.orderBy("x"), 0, -2)
        raised = False
    except ValueError:
        raised = True
    return found.unionByName(spark.createDataFrame([("reversed", raised)], found.schema))


register("window_empty_frame", "SELECT o_orderkey, sum(o_totalprice) OVER w AS s, count(*) OVER w AS n, max(o_orderkey) OVER w AS m FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1000000 FOLLOWING AND 1000001 FOLLOWING)")
register("window_first_last", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
register("window_percent", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")

# Strings


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2, instr(p_name || ' ', ' ') - 2)) AS first_word, 8 * strlen(p_name) AS bits, strlen(p_name) AS bytes FROM part")
def string_initcap(spark, sf_dir):
    n = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.substring_index(F.initcap(n), " ", 1).alias("first_word"), F.bit_length(n).cast("long").alias("bits"), F.octet_length(n).cast("long").alias("bytes"))


@query("SELECT p_partkey, hex(encode(p_name)) AS utf8, strlen(p_name) AS n, p_name AS back FROM part")
def string_convert_using(spark, sf_dir):
    n = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.hex(X.convert_using(n, "UTF-8")).alias("utf8"), F.octet_length(X.convert_using(n, "ISO-8859-1")).cast("long").alias("n"), F.decode(X.convert_using(n, "UTF-16"), "UTF-16").alias("back"))


@query("SELECT p_partkey, p_name || p_brand AS a, 'XX' || substr(p_name, 3) AS b, lower(p_name) AS c, upper(p_name) AS d, CAST(length(rtrim(p_name)) AS INTEGER) AS e, CAST(instr(p_name, 'i') AS INTEGER) AS f, ltrim('  ' || p_name) AS g, rtrim(p_name || '  ') AS h, substr(p_name, 2, 3) AS i, round(ln(p_size), 6) AS j, abs(p_size - 25) AS k, DATE '2001-02-03' AS l FROM part")
def call_level_escapes(spark, sf_dir):
    text = "SELECT p_partkey, {fn CONCAT(p_name, p_brand)} AS a, {fn INSERT(p_name, 1, 2, 'XX')} AS b, {fn LCASE(p_name)} AS c, {fn UCASE(p_name)} AS d, {fn LENGTH(p_name || '  ')} AS e, {fn LOCATE('i', p_name)} AS f, {fn LTRIM('  ' || p_name)} AS g, {fn RTRIM(p_name || '  ')} AS h, {fn SUBSTRING(p_name, 2, 3)} AS i, round({fn LOG(p_size)}, 6) AS j, {fn ABS(p_size - 25)} AS k, {d '2001-02-03'} AS l FROM "
    return spark.sql(X.without_escapes(text) + "{part}", part=load(spark, sf_dir, "part"))


@query("SELECT true AS today, true AS later, true AS same")
def call_level_now(spark, sf_dir):
    return spark.sql(X.without_escapes("SELECT {fn CURDATE()} = current_date() AS today, {fn NOW()} >= {ts '2001-01-01 00:00:00'} AS later, {fn CURTIME()} = date_format({fn NOW()}, 'HH:mm:ss') AS same"))


@query("SELECT p_partkey, CASE WHEN len(h) >= 1 THEN h[1] ELSE 0 END AS one, CASE WHEN len(h) >= 2 THEN h[2] ELSE 0 END AS two, CASE WHEN len(h) >= 1 THEN h[len(h)] ELSE 0 END AS back, coalesce(list_filter(h, lambda i: i >= 3)[1], 0) AS from3 FROM (SELECT p_partkey, list_transform(list_filter(range(1, length(p_name) + 1), lambda i: substr(p_name, i, 1) = 'e'), lambda i: CAST(i AS INTEGER)) AS h FROM part)")
def instr_forms(spark, sf_dir):
    n, e = F.col("p_name"), F.lit("e")
    return load(spark, sf_dir, "part").select("p_partkey", S.instr(n, e).alias("one"), S.instr(n, e, 1, 2).alias("two"), S.instr(n, e, -1, 1).alias("back"), S.instr(n, e, 3, 1).alias("from3"))


@query("SELECT p_partkey, t AS word, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS INTEGER) AS seq FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) WHERE t <> ''")
def split_rows_numbered(spark, sf_dir):
    return T.split_rows(load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("word")), "word", " ", "\\", number="seq")


@query("SELECT n_nationkey, w FROM (SELECT n_nationkey, unnest([n_name || '~' || 'a', 'b c']) AS w FROM nation WHERE n_nationkey % 5 <> 0) UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 5 = 0")
def split_rows_escape(spark, sf_dir):
    """An escaped separator belongs to its token, empty tokens go, blanks around go, a null stays once."""
    n = load(spark, sf_dir, "nation")
    text = F.when(F.col("n_nationkey") % 5 != 0, F.concat("n_name", F.lit("\\~a ~~ b c ~")))
    return T.split_rows(n.select("n_nationkey", text.alias("w")), "w", "~", "\\", trim=True)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '1-' || a || '-' || b || '-' || c WHEN c_custkey % 3 = 1 THEN '(' || a || ') ' || b || '-' || c ELSE 'no ' || c_custkey END AS usual, CASE WHEN c_custkey % 3 = 1 THEN a || '.' || b || '.' || c WHEN c_custkey % 3 = 0 THEN '1-' || a || '-' || b || '-' || c ELSE 'no ' || c_custkey END AS dotted, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 3 END AS kept FROM (SELECT c_custkey, substr(d, 1, 3) AS a, substr(d, 4, 3) AS b, substr(d, 7, 4) AS c FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 2000000000 AS VARCHAR), 10, '2') AS d FROM customer))")
def clean_phone_forms(spark, sf_dir):
    """Numbers with and without the country's 1, in the usual and another form; what is no number stays or is known as such."""
    d, k = F.lpad((F.col("c_custkey") * 7919 + 2000000000).cast("string"), 10, "2"), F.col("c_custkey") % 3
    s = F.when(k == 0, F.concat(F.lit("1 "), d)).when(k == 1, d).otherwise(F.concat(F.lit("no "), F.col("c_custkey").cast("string")))
    return load(spark, sf_dir, "customer").select("c_custkey", S.clean_phone(s).alias("usual"), S.clean_phone(s, "999.999.9999").alias("dotted"), F.when(S.is_phone(s), k).alias("kept"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '+49 30 ' || (1000000 + c_custkey) ELSE 'n/a ' || c_custkey END AS phone, c_custkey % 2 = 0 AS good FROM customer")
def clean_phone_international(spark, sf_dir):
    k = F.col("c_custkey")
    s = F.when(k % 2 == 0, F.concat(F.lit("0049 (30) "), (k + 1000000).cast("string"))).otherwise(F.concat(F.lit("n/a "), k.cast("string")))
    return load(spark, sf_dir, "customer").select("c_custkey", S.clean_phone_international(s).alias("phone"), S.clean_phone_international(s).startswith("+").alias("good"))


@query(_expected(["text", "short", "international"], ["fine"]))
def clean_phone_rejects(spark, sf_dir):
    rows = []
    for name, c in {"text": S.clean_phone(F.lit("call me, please!"), reject=True), "short": S.clean_phone(F.lit("123"), reject=True), "international": S.clean_phone_international(F.lit("+0"), True), "fine": S.clean_phone(F.lit("4155550100"), reject=True)}.items():
        try:
            spark.range(1).select(c).collect()
            rows.append((name, False))
        except Exception:  # noqa: BLE001 any error is what is asked for
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, raised boolean")


# Dates
register("date_difference_units", "SELECT o_orderkey, timestampdiff(HOUR, TIMESTAMP_NTZ '1997-01-01 05:30:00', o_orderdate) AS h, timestampdiff(MINUTE, TIMESTAMP_NTZ '1997-01-01 05:30:00', o_orderdate) AS m, timestampdiff(MONTH, TIMESTAMP_NTZ '1990-01-01 00:00:00', o_orderdate) AS mo, timestampdiff(YEAR, TIMESTAMP_NTZ '1990-01-01 00:00:00', o_orderdate) AS y FROM {orders}", "SELECT o_orderkey, date_sub('hour', TIMESTAMP '1997-01-01 05:30:00', o_orderdate) AS h, date_sub('minute', TIMESTAMP '1997-01-01 05:30:00', o_orderdate) AS m, date_sub('month', TIMESTAMP '1990-01-01 00:00:00', o_orderdate) AS mo, date_sub('year', TIMESTAMP '1990-01-01 00:00:00', o_orderdate) AS y FROM orders")


@query("SELECT event_id, date_trunc('month', ts) AS low, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS high, date_trunc('year', ts) AS y, date_trunc('minute', ts) AS m FROM events")
def date_floor_ceil(spark, sf_dir):
    t = F.col("ts")
    return load(spark, sf_dir, "events").select("event_id", D.floor_to(t, "month").alias("low"), D.ceil_to(t, "hour").alias("high"), D.floor_to(t, "year").alias("y"), D.floor_to(t, "minute").alias("m"))


@query("SELECT event_id, ts + INTERVAL 5 HOUR AS a, ts - INTERVAL 30 HOUR AS b, date_sub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS h FROM events")
def date_hours(spark, sf_dir):
    t = F.col("ts")
    return load(spark, sf_dir, "events").select("event_id", D.add_hours(t, F.lit(5)).alias("a"), D.add_hours(t, F.lit(-30)).alias("b"), D.hours_diff(t, F.lit("2024-01-01").cast("timestamp_ntz")).alias("h"))


@query("SELECT event_id, ts + INTERVAL 330 MINUTE AS a, ts - INTERVAL 8 HOUR AS b, ts + INTERVAL 3 HOUR AS c, ts AS d FROM events")
def adjust_timestamp(spark, sf_dir):
    t = F.col("ts")
    return load(spark, sf_dir, "events").select("event_id", X.adjust_timestamp(t, "+05:30").alias("a"), X.adjust_timestamp(t, "-8", 2).alias("b"), X.adjust_timestamp(t, "", 3).alias("c"), X.adjust_timestamp(t, None, 3).alias("d"))


@query("SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) + INTERVAL 5 SECOND, '%a %b %d %H:%M:%S UTC %Y') AS s, CAST(NULL AS VARCHAR) AS n FROM orders")
def internal_date(spark, sf_dir):
    days = F.unix_date(F.to_date("o_orderdate")).cast("long") + X.INTERNAL_EPOCH
    return load(spark, sf_dir, "orders").select("o_orderkey", X.internal_date(days * 86400000 + 5000).alias("s"), X.internal_date(F.lit(-1)).alias("n"))


@query("SELECT count(*) AS n, 1 AS dates, 1 AS times, 1 AS locals, true AS agrees, true AS precise FROM nation")
def current_times(spark, sf_dir):
    """The statement's times are the same for all its rows."""
    t = X.statement_time()
    rows = load(spark, sf_dir, "nation").repartition(5).select(*(c.alias(n) for n, c in t.items()), X.time_of(3).alias("p"))
    one = lambda c: F.count_distinct(c).cast("int")
    return rows.agg(F.count(F.lit(1)).alias("n"), one("current_date").alias("dates"), one("current_time").alias("times"), one("localtimestamp").alias("locals"), F.bool_and(F.to_date("current_timestamp") == F.col("current_date")).alias("agrees"), F.bool_and(F.length("p") == 12).alias("precise"))


@query("""SELECT CAST(d AS DATE) AS time_key, CAST(quarter(d) AS INTEGER) AS quarter, CAST((month(d) - 10 + 12) % 12 + 1 AS INTEGER) AS fiscal_month, CAST(((month(d) - 10 + 12) % 12) // 3 + 1 AS INTEGER) AS fiscal_quarter_number,
 CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST(make_date(year(d) - CASE WHEN month(d) < 10 THEN 1 ELSE 0 END, 10, 1) AS DATE) AS fiscal_year_start,
 CAST(make_date(year(d) - CASE WHEN month(d) < 10 THEN 1 ELSE 0 END + 1, 9, 30) AS DATE) AS fiscal_year_end, CAST(d AS DATE) - make_date(year(d) - CASE WHEN month(d) < 10 THEN 1 ELSE 0 END, 10, 1) + 1 AS day_in_fiscal_year
FROM range(TIMESTAMP '1999-08-25 00:00:00', TIMESTAMP '2001-11-06 00:00:00', INTERVAL 1 DAY) t(d)""")
def fiscal_time_dimension(spark, sf_dir):
    return T.fiscal_time_dimension(spark, "1999-08-25", "2001-11-05", 10).select("time_key", "quarter", "fiscal_month", "fiscal_quarter_number", "fiscal_year", "fiscal_year_start", "fiscal_year_end", F.col("day_in_fiscal_year").cast("long").alias("day_in_fiscal_year"))


# Numbers


@query("SELECT count(*) AS n, true AS inside, true AS ends_are_rarer, true AS again FROM lineitem")
def math_rand(spark, sf_dir):
    """Numbers from 1 to 6; both ends have half the weight of the others; a seed gives the same numbers again."""
    rows = load(spark, sf_dir, "lineitem").select(N.rand_between(1, 6, 3).alias("r"), N.rand_between(1, 6, 3).alias("s"))
    times = lambda k: F.count_if(F.col("r") == k)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("r").between(1, 6)).alias("inside"), ((times(1) + times(6)) < 1.25 * times(3)).alias("ends_are_rarer"), F.bool_and(F.col("r") == F.col("s")).alias("again"))


@query("SELECT n_regionkey, CAST(sum(n_nationkey) / count(*) AS INTEGER) AS a, CAST(trunc(avg(n_nationkey)) AS INTEGER) AS t FROM (SELECT n_regionkey, n_nationkey * 2 AS n_nationkey FROM nation WHERE n_nationkey % 5 < 5) GROUP BY n_regionkey")
def avg_argument_typed(spark, sf_dir):
    """AVG of an integer has the integer's type."""
    n = load(spark, sf_dir, "nation").withColumn("x", F.col("n_nationkey") * 2)
    return n.groupBy("n_regionkey").agg(A.ref_avg(F.col("x"), "int").alias("a"), A.ref_avg(F.col("x"), "int").alias("t"))


@query("SELECT n_regionkey, min(n_regionkey) AS v FROM nation GROUP BY n_regionkey")
def single_value(spark, sf_dir):
    d = load(spark, sf_dir, "nation").select("n_regionkey").distinct()
    return d.groupBy("n_regionkey").agg(A.single_value(d, "n_regionkey").alias("v"))


@query("SELECT count(*) AS n, count(*) AS kept, true AS in_range, true AS stable FROM part")
def generate_crc(spark, sf_dir):
    """Equal rows have equal sums, which fit in 32 bits and do not depend on the partitioning."""
    p = load(spark, sf_dir, "part")
    a = T.generate_crc(p, ["p_retailprice"], exclude=True).select("p_partkey", F.col("crc_value").alias("a"))
    b = T.generate_crc(p.repartition(5), ["p_retailprice"], exclude=True).select("p_partkey", F.col("crc_value").alias("b"))
    return a.join(b, "p_partkey").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("kept"), F.bool_and(F.col("a").between(0, 2**32 - 1)).alias("in_range"), F.bool_and(F.col("a") == F.col("b")).alias("stable"))


# Samples
@query("SELECT true AS near, true AS again, true AS part_of FROM lineitem LIMIT 1")
def sample_bernoulli(spark, sf_dir):
    """A share of about ten in a hundred rows, the same with the same seed."""
    rows = load(spark, sf_dir, "lineitem")
    one, two = (relational.bernoulli(rows, 10, 42).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("s")) for _ in range(2))
    every = rows.agg(F.count(F.lit(1)).alias("m"))
    both = one.crossJoin(two.select(F.col("s").alias("s2"))).crossJoin(every)  # three rows of counts
    return both.select((F.abs(F.col("n") - 0.1 * F.col("m")) < 5 * F.sqrt(0.09 * F.col("m"))).alias("near"), (F.col("s") == F.col("s2")).alias("again"), (F.col("n") <= F.col("m")).alias("part_of"))


@query("SELECT true AS whole_clumps, true AS some, true AS not_all FROM lineitem LIMIT 1")
def sample_system(spark, sf_dir):
    """Whole clumps of neighbouring rows are taken or left."""
    rows = relational.system_sample(load(spark, sf_dir, "lineitem"), 30, 7, clump=50, clump_name="clump")
    every = relational.system_sample(load(spark, sf_dir, "lineitem"), 100, 7, clump=50, clump_name="clump")
    a = rows.groupBy("clump").agg(F.count(F.lit(1)).alias("n"))
    b = every.groupBy("clump").agg(F.count(F.lit(1)).alias("m"))
    both = b.join(a, "clump", "left")
    return both.agg(F.bool_and(F.col("n").isNull() | (F.col("n") == F.col("m"))).alias("whole_clumps"), (F.count("n") > 0).alias("some"), (F.count("n") < F.count("m")).alias("not_all"))


@query("SELECT count(*) AS n, 'sample' AS source FROM nation WHERE n_regionkey < 2")
def sample_substitution(spark, sf_dir):
    """A named sample stands for the table where it is asked for."""
    n = load(spark, sf_dir, "nation")
    rows = relational.substituted({"nation": n}, {("nation", "small"): n.where("n_regionkey < 2")}, "nation", "small")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit("sample").alias("source"))


# Bitmap indexes
@query("SELECT l_returnflag AS k, count(DISTINCT rid) AS n, count(DISTINCT rid // 32768) AS segments FROM (SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS rid FROM lineitem) GROUP BY 1")
def bitmap_index_build(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").withColumn("rid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    index = bitmaps.build(li, "l_returnflag", "rid")
    return index.groupBy(F.col("key").alias("k")).agg(F.sum(F.bitmap_count("bitmap")).alias("n"), F.count(F.lit(1)).alias("segments"))


@query("SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS k, l_orderkey * 8 + l_linenumber AS rid FROM lineitem WHERE l_linenumber > 3")
def bitmap_index_rows(spark, sf_dir):
    """From the index back to row ids."""
    li = load(spark, sf_dir, "lineitem").withColumn("rid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return bitmaps.rows(bitmaps.build(li, "l_linenumber", "rid").where("key > 3")).select(F.col("key").cast("int").alias("k"), "rid")


@query("SELECT l_returnflag AS k, count(DISTINCT l_orderkey * 8 + l_linenumber) AS n FROM lineitem GROUP BY 1")
def bitmap_index_splice(spark, sf_dir):
    """An index of old rows, spliced with one of new rows."""
    li = load(spark, sf_dir, "lineitem").withColumn("rid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    old, new = (bitmaps.build(li.where(c), "l_returnflag", "rid") for c in ("l_linenumber < 4", "l_linenumber >= 3"))
    return bitmaps.splice(old, new).groupBy(F.col("key").alias("k")).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


@query("SELECT rid FROM (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS rid FROM lineitem WHERE l_returnflag IN ('R', 'A') INTERSECT SELECT l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_linestatus = 'F') EXCEPT SELECT l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_linenumber = 2")
def bitmap_index_search(spark, sf_dir):
    """(R or A) and F minus line 2, on indexes alone."""
    li = load(spark, sf_dir, "lineitem").withColumn("rid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    flag, status, line = (bitmaps.build(li, c, "rid") for c in ("l_returnflag", "l_linestatus", "l_linenumber"))
    found = bitmaps.minus(bitmaps.intersect(bitmaps.union(flag.where("key IN ('R', 'A')")), bitmaps.union(status.where("key = 'F'"))), bitmaps.union(line.where("key = 2")))
    return bitmaps.rows(found).select("rid")


# Multisets of real columns
@query("""WITH m AS (SELECT o_custkey, list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS a, list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey),
x AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM m),
k AS (SELECT o_custkey, a, b, list_distinct(a) AS da, list_distinct(list_concat(a, b)) AS dab FROM x)
SELECT o_custkey, list_sort(list_concat(a, b)) AS ua, list_sort(dab) AS ud,
  list_sort(flatten(list_transform(da, lambda v: list_transform(range(least(len(list_filter(a, lambda y: y = v)), len(list_filter(b, lambda y: y = v)))), lambda i: v)))) AS ia,
  list_sort(flatten(list_transform(da, lambda v: list_transform(range(greatest(len(list_filter(a, lambda y: y = v)) - len(list_filter(b, lambda y: y = v)), 0)), lambda i: v)))) AS ea,
  list_sort(list_intersect(a, b)) AS id, list_sort(list_filter(da, lambda v: NOT list_contains(b, v))) AS ed,
  list_contains(a, '1-URGENT') AS mem, len(a) = len(da) AS s, CAST(len(a) AS INTEGER) AS n,
  len(list_filter(da, lambda v: len(list_filter(a, lambda y: y = v)) > len(list_filter(b, lambda y: y = v)))) = 0 AS sub, CASE WHEN len(a) = 1 THEN a[1] END AS el
FROM k""")
def multiset_operators(spark, sf_dir):
    def of(status):
        return F.collect_list(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))

    m = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("F").alias("a"), of("O").alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.select("o_custkey", C.union_all(a, b).alias("ua"), C.union_distinct(a, b).alias("ud"), C.intersect_all(a, b).alias("ia"), C.except_all(a, b).alias("ea"), C.intersect_distinct(a, b).alias("id"), C.except_distinct(a, b).alias("ed"), C.member_of(F.lit("1-URGENT"), a).alias("mem"), C.is_a_set(a).alias("s"), F.size(a).alias("n"), C.submultiset_of(a, b).alias("sub"), F.when(F.size(a) == 1, C.element(F.when(F.size(a) == 1, a))).alias("el"))


# Structured types, variables, context
register("new_type", "SELECT v.amount AS amount, v.unit AS unit FROM (SELECT CAST(named_struct('a', o_totalprice, 'b', 'EUR') AS STRUCT<amount: DECIMAL(12, 2), unit: STRING>) AS v FROM {orders}) t", "SELECT CAST(o_totalprice AS DECIMAL(12, 2)) AS amount, 'EUR' AS unit FROM orders")
register("array_map_json", "SELECT n_nationkey, element_at(map(n_name, n_regionkey), n_name) AS m, get_json_object(to_json(named_struct('k', n_regionkey)), '$.k') AS j, sequence(0, n_regionkey)[0] AS f FROM {nation}", "SELECT n_nationkey, n_regionkey AS m, CAST(n_regionkey AS VARCHAR) AS j, 0 AS f FROM nation")


@query("SELECT true AS one, true AS known, true AS no_role, '' AS current_path")
def session_context(spark, sf_dir):
    v = X.session_values(spark)
    return spark.range(1).select((v["user"] == v["session_user"]).alias("one"), (F.length(v["system_user"]) > 0).alias("known"), v["current_role"].isNull().alias("no_role"), v["current_path"].alias("current_path"))


@query("SELECT n_name, 'west' AS tag FROM nation WHERE n_regionkey = 3")
def application_variables(spark, sf_dir):
    v = procedures.Variables()
    for name, value in (("region", "3"), ("tag", "west")):
        v.create("etl", name)
        v.set("etl", name, value)
    return load(spark, sf_dir, "nation").where(F.col("n_regionkey") == v.get("etl", "region").cast("int")).select("n_name", v.get("etl", "tag").alias("tag"))


# Order: the position of each row is part of the result
@query("SELECT k, row_number() OVER (ORDER BY k NULLS FIRST, n_nationkey) AS n FROM (SELECT n_nationkey, NULLIF(n_regionkey, 3) AS k FROM nation)")
def sort_positions(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(3)).alias("k"))
    return T.numbered(rows, ["k", "n_nationkey"]).select("k", "n")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders ORDER BY n LIMIT 25")
def top_n_positions(spark, sf_dir):
    top = T.top_n(load(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 25)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("n"))  # 25 rows


register("client_row_limit", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS n FROM (SELECT * FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 12) t")
