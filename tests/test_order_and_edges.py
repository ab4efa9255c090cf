"""Order of results, joins over edges, files, bitmaps, and plans."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import context as X
from millrace.operators import bitmaps, procedures
from millrace.operators import relational as R
from millrace.operators import table_functions as T
from millrace.plans.registry import ORACLE_SQL, QUERIES
from millrace.sources import catalog, flatfile, partitioned


@pytest.mark.parametrize("name", ["sort_nulls_low", "sort_desc_limit", "sort_offset", "sort_ordinal", "top_n", "top_n_positions", "client_row_limit"])
def test_rows_come_in_order(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("nation", "orders", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cur = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert [tuple(r[n] for n in names) for r in df.collect()] == cur.fetchall()


def test_nulls_come_first(spark):
    d = spark.createDataFrame([(3,), (None,), (1,)], "k int")
    assert [r.k for r in d.orderBy("k").collect()] == [None, 1, 3]
    assert [r.k for r in d.orderBy(F.desc("k")).collect()] == [3, 1, None]
    assert [(r.k, r.n) for r in T.numbered(d, ["k"]).orderBy("n").collect()] == [(None, 1), (1, 2), (3, 3)]


def test_a_sort_below_a_sort_goes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    assert procedures.plan_of(o.orderBy("o_totalprice").orderBy("o_orderkey"), "simple").count("Sort [") == 1


@pytest.mark.parametrize("seed", range(3))
def test_range_join_of_any_length(spark, seed):
    rnd = random.Random(seed)
    points = [(i, rnd.uniform(-50, 2000)) for i in range(150)] + [(900, None), (901, 10.0)]
    ranges = [(i, a, a + rnd.choice([0, 0.5, 3, 40, 700, 1e5])) for i, a in enumerate(rnd.uniform(-60, 1500) for _ in range(60))] + [(98, None, 5.0), (99, 10.0, 10.0), (100, 10.0, 11.0)]
    p, r = spark.createDataFrame(points, "i int, at double"), spark.createDataFrame(ranges, "j int, lo double, hi double")
    want = sorted((i, j) for i, x in points for j, a, b in ranges if None not in (x, a) and a <= x < b)
    assert sorted((x.i, x.j) for x in R.range_join(p, r, "at", "lo", "hi", 1.0).collect()) == want


def test_overlap_join(spark):
    rnd = random.Random(4)
    some = [(i, a, a + rnd.choice([0.0, 0.3, 2.5, 30.0])) for i, a in enumerate(rnd.uniform(-20, 60) for _ in range(80))]
    a, b = spark.createDataFrame(some, "i int, s double, e double"), spark.createDataFrame(some[::-1], "j int, s2 double, e2 double")
    want = sorted((i, j) for i, s, e in some for j, t, f in some if s < e and t < f and s < f and t < e)
    assert sorted((x.i, x.j) for x in R.overlap_join(a, b, "s", "e", "s2", "e2", 1.0).collect()) == want


def test_overlap_pairs(spark):
    rnd = random.Random(5)
    some = [(i, a / 2, a / 2 + rnd.choice([-1.0, 0.0, 0.5, 2.5, 300.0])) for i, a in enumerate(rnd.randrange(-40, 120) for _ in range(90))] + [(3, 0.0, 9.0), (200, None, 1.0), (201, 1.0, None)]
    d = spark.createDataFrame(some, "k int, s double, e double")
    want = sorted((i, j) for i, s, e in some for j, t, f in some if i < j and None not in (s, e, t, f) and s < e and t < f and s < f and t < e)
    assert sorted(tuple(r) for r in R.overlap_pairs(d, "k", "s", "e", 0.5).collect()) == want


def test_range_join_makes_pairs_from_arrays(spark):
    """What is sorted, sent or held for the join is a bin's ranges as arrays and the points near ranges, no row for a pair."""
    p = spark.range(40_000).selectExpr("id AS i", "IF(id < 300, 7.5, 1000.0 + id) AS at")
    r = spark.range(3000).selectExpr("id AS j", "CAST(id % 8 AS double) AS lo", "id % 8 + IF(id % 100 = 0, 500.0, 1.0) AS hi", "map('k', id) AS m")
    for some in (r, r.drop("m")):
        df = R.range_join(p, some, "at", "lo", "hi", 1.0)
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate inline(__rows" in text and "NestedLoop" not in text
        got = df.agg(F.count("*"), F.count_distinct("i", "j"), F.sum("j")).first()
        want = [j for j in range(3000) if j % 8 <= 7.5 < j % 8 + (500 if j % 100 == 0 else 1)]
        assert tuple(got) == (300 * len(want), 300 * len(want), 300 * sum(want))


@pytest.mark.parametrize("name", ["join_range_binned", "join_range_long", "period_overlaps_binned"])
def test_range_queries_make_pairs_from_arrays(spark, sf_dir, name):
    assert "Generate inline(__rows" in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_as_of_over_cuts(spark, parts):
    rnd, day = random.Random(parts), datetime.datetime(2024, 1, 1)
    left = [(i, rnd.choice("ab"), day + datetime.timedelta(minutes=rnd.randrange(5000))) for i in range(120)] + [(500, "c", day), (501, None, day)]
    right = [(rnd.choice("ab"), day + datetime.timedelta(minutes=rnd.randrange(5000), seconds=i), i) for i in range(60)] + [("a", day - datetime.timedelta(1), -1), ("c", day, 7)]
    a, b = spark.createDataFrame(left, "i int, k string, at timestamp_ntz"), spark.createDataFrame(right, "k string, at timestamp_ntz, v int")
    want = {i: max(((t, v) for x, t, v in right if x == k and t <= at), default=(None, None))[1] for i, k, at in left}
    assert {r.i: r.last_v for r in R.as_of(a, b, "k", "at", ["v"], parts).collect()} == want
    assert R.as_of(a.limit(0), b, "k", "at", ["v"], parts).count() == 0


def test_bitmaps(spark):
    some = [(k, i) for i in (0, 1, 7, 8, 32767, 32768, 70000, 70001) for k in ("x" if i % 2 else "y", None if i > 60000 else "z")]
    index = bitmaps.build(spark.createDataFrame(some, "k string, rid long"), "k", "rid")
    assert sorted(((r.key, r.rid) for r in bitmaps.rows(index).collect()), key=str) == sorted(some, key=str)
    x, z = bitmaps.union(index.where("key = 'x'")), bitmaps.union(index.where("key = 'z'"))
    assert sorted(r.rid for r in bitmaps.rows(bitmaps.intersect(x, z)).collect()) == [1, 7, 32767]
    assert sorted(r.rid for r in bitmaps.rows(bitmaps.minus(x, z)).collect()) == [70001]
    assert sorted(r.rid for r in bitmaps.rows(bitmaps.minus(z, x)).collect()) == [0, 8, 32768]


def test_types_come_from_the_first_rows(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b\n" + "".join(f"{i},t{i}\n" for i in range(20)) + "x,last\n")
    rows, bad = flatfile.read(spark, str(tmp_path / "f.csv"), sample_rows=5)
    assert [f.dataType.simpleString() for f in rows.schema] == ["int", "string"]
    assert rows.count() == 20 and [r.line for r in bad.collect()] == ["x,last"]


def test_escapes():
    assert X.without_escapes("SELECT {fn UCASE(a)}, '{fn x}' , {fn LCASE({fn UCASE(b)})}") == "SELECT upper(a), '{fn x}' , lower(upper(b))"
    assert X.without_escapes("{ts '2001-01-01 00:00:00'} {oj a LEFT JOIN b ON x}") == "TIMESTAMP '2001-01-01 00:00:00' a LEFT JOIN b ON x"
    with pytest.raises(ValueError):
        X.without_escapes("{zz 1}")


def test_context_functions(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(X.cast_text(F.lit(" 2.5 "), "int")) == 3 and value(X.cast_text(F.lit("-2.5"), "smallint")) == -3
    assert value(X.cast_char(F.lit("ab"), 4)) == "ab  " and value(X.cast_char(F.lit("abcdef"), 4)) == "abcd"
    assert value(X.between_symmetric(F.lit(5), F.lit(9), F.lit(1))) and not value(X.between_symmetric(F.lit(0), F.lit(9), F.lit(1)))
    assert value(X.between_symmetric(F.lit(5), F.lit(None).cast("int"), F.lit(1))) is None
    assert value(X.internal_date(F.lit(719163 * 86400000).cast("long"))) == "Thu Jan 01 00:00:00 UTC 1970"
    assert value(X.difference(F.lit("2001-03-01").cast("date"), F.lit("2001-01-31").cast("date"), "month")) == 1
    with pytest.raises(ValueError):
        X.time_of(4)


def test_collapse_limit(spark):
    d = spark.createDataFrame([("p", i, "x" * 10) for i in range(5)], "p string, i int, c string")
    assert T.collapse_rows(d, "p", "c", ["i"], ",", most=54).count() == 1
    with pytest.raises(Exception, match="22001"):
        T.collapse_rows(d, "p", "c", ["i"], ",", most=53).collect()


def test_routines(spark):
    d = spark.createDataFrame([(1, "a", 2.5)], "i int, s string, x double")
    r = procedures.Routines()
    r.add("f", ["bigint"], lambda x: x + 1)
    r.add("f", ["string"], lambda x: F.upper(x))
    assert d.select(r.call(d, "f", "i"), r.call(d, "f", "s")).first()[:] == (2, "A")
    with pytest.raises(LookupError):
        r.call(d, "f", "x")
    with pytest.raises(ValueError):
        r.add("f", ["string"], F.lower)
    with pytest.raises(LookupError):
        procedures.Procedures().call(spark, "none")


def test_partitioned_and_mock(spark, tmp_path):
    t = partitioned.PartitionedTable(spark, str(tmp_path / "p"), "k")
    t.write(spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, k int"), files=4)
    assert t.partition(1).count() == 10 and "PartitionFilters: [isnotnull(k" in t.partition(1)._jdf.queryExecution().executedPlan().toString()
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    facts = t.read()
    assert partitioned.replica_join(facts, small, facts["k"] == small["k"]).count() == 20
    assert catalog.chosen(["a1", "b1", "c"], limit_to=["_1"], except_=["b%"]) == ["a1"]
    assert catalog.mock(spark, spark.createDataFrame([], "d date, t timestamp, s string, x double, b boolean").schema, 7).count() == 7


def test_remote_queries(spark):
    """A database in this process's memory stands for a remote one; a join is done there."""
    url = "jdbc:derby:memory:remote;create=true"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.jdbc(url, "t", "overwrite")
    spark.createDataFrame([(1, 10.0), (1, 5.0)], "k int, x double").write.jdbc(url, "u", "overwrite")
    got = catalog.jdbc(spark, url, 'SELECT t."v" AS v, u."x" AS x FROM t JOIN u ON t."k" = u."k"')
    assert sorted(tuple(r) for r in got.collect()) == [("a", 5.0), ("a", 10.0)]


def test_settings_and_servers(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), procedures.settings(spark, spark__sql__shuffle__partitions="7"):
        assert spark.conf.get(key) == "7"
        raise KeyError
    assert spark.conf.get(key) == before
    s = procedures.Servers()
    s.create("a", lambda name: spark.range(len(name)))
    assert s.table("a", "four").count() == 4
    with pytest.raises(ValueError):
        s.create("a", None)
    s.drop("a")
    with pytest.raises(LookupError):
        s.table("a", "x")
