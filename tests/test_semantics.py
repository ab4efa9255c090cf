"""Rules that the SQL comparison does not reach."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import aggregates as A
from millrace.functions import collections as C
from millrace.functions import datetimes as D
from millrace.functions import numerics as N
from millrace.functions import strings as S
from millrace.operators import dml
from millrace.operators import relational as R
from millrace.operators import table_functions as T
from millrace.plans.registry import QUERIES
from millrace.sources import catalog, flatfile
from millrace.streaming import windows


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [(1, 7, "0.142857"), (-20, 3, "-6.666667"), (10, 2, "5.000000")])
def test_quotient(spark, a, b, want):
    assert str(value(spark, N.quotient(F.lit(a), F.lit(b)))) == want


def test_errors(spark):
    for c in (N.quotient(F.lit(1), F.lit(0)), N.ln(F.lit(0.0)), S.left_n(F.lit("a"), F.lit(-1)), N.mod(F.lit(1), F.lit(0)), C.element(F.array(F.lit(1), F.lit(2))), S.clean_phone(F.lit("x"), reject=True)):
        with pytest.raises(Exception):  # noqa: B017
            value(spark, c)
    for start, nth in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            S.instr(F.lit("a"), F.lit("a"), start, nth)


def test_rounding_cast(spark):
    assert [value(spark, N.to_integer(F.lit(x))) for x in (1.8, -1.8, 0.5)] == [2, -2, 1]
    assert value(spark, N.mod(F.lit(-7), F.lit(3))) == -1
    assert value(spark, N.int_div(F.lit(1), F.lit(3))) == 0


@pytest.mark.parametrize(("sub", "start", "nth", "want"), [("a", 1, 1, 2), ("a", 3, 1, 4), ("a", 1, 3, 6), ("a", -1, 1, 6), ("a", -2, 2, 2), ("", 1, 1, 0), ("x", 1, 1, 0), ("bananas", 1, 1, 0)])
def test_instr(spark, sub, start, nth, want):
    assert value(spark, S.instr(F.lit("banana"), F.lit(sub), start, nth)) == want


def test_strings(spark):
    assert value(spark, S.clean_phone(F.lit("1800TESTING"))) == "1-800-837-8464"
    assert value(spark, S.clean_phone(F.lit("415.555.1234"))) == "(415) 555-1234"
    assert value(spark, S.clean_phone(F.lit("12"))) == "12"
    assert value(spark, S.clean_phone_international(F.lit("0049 (30) 1234-567"))) == "+49 30 1234 567"
    assert value(spark, S.str_replace(F.lit("abc"), F.lit(""), F.lit("x"))) == "abc"
    assert value(spark, S.right_n(F.lit("abc"), F.lit(9))) == "abc"
    assert value(spark, S.similar_to(F.lit("a.c"), "a!.c", "!")) and not value(spark, S.similar_to(F.lit("abc"), "a.c"))


def test_dates(spark):
    d = F.lit("1996-02-10").cast("date")
    assert value(spark, D.calendar_quarter(d)) == "Q1CY96"
    assert value(spark, D.fiscal_quarter(F.lit("1999-12-01").cast("date"), 10)) == "Q1FY00"
    assert value(spark, D.fiscal_year(d, 1)) == 1996
    assert value(spark, D.julian_to_date(D.julian_day(d))) == datetime.date(1996, 2, 10)
    assert value(spark, D.convert_date(F.lit("31-JAN-99"), "DD-MON-YYYY")) is None
    ts = F.lit("2001-03-07 10:20:30").cast("timestamp")
    assert value(spark, D.extract_timestamp(ts, "MONTH")) == 2
    assert value(spark, D.truncate_timestamp(ts, "other")) == datetime.datetime(2001, 3, 7, 10, 20, 30)
    assert str(value(spark, D.ceil_to(ts, "hour"))) == "2001-03-07 11:00:00"
    assert value(spark, D.hours_diff(D.add_hours(ts, F.lit(5)), ts)) == 5


def test_single_value(spark):
    df = spark.range(2)
    assert df.where("id = 1").agg(A.single_value(df, "id")).first()[0] == 1
    with pytest.raises(Exception):  # noqa: B017
        df.agg(A.single_value(df, "id")).collect()


def test_collapse_rows_all_null(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2), ("b", None, 3), ("b", "y", 4)], "p string, c string, o int")
    got = {r[0]: (r[1], r[2]) for r in T.collapse_rows(df, "p", "c", ["o"], "~").collect()}
    assert got == {"a": (None, 0), "b": ("x~y", 2)}


def test_sequence_step(spark):
    with pytest.raises(ValueError):
        T.generate_sequence(spark.range(3), [], ["id"], 1, 0)
    assert sorted(r["seq"] for r in T.generate_sequence(spark.range(50).repartition(6), [], ["id"], None, None).collect()) == list(range(1, 51))


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "a,b\\,c,,d "), (2, None), (3, ",,")], "k int, s string")
    got = sorted((r.k, r.s or "") for r in T.split_rows(df, "s", ",", "\\", True).collect())
    assert got == [(1, "a"), (1, "b,c"), (1, "d"), (2, ""), (3, "")]
    assert T.split_rows(df, "s", None, "\\").count() == 0


def test_flatten_cycle_and_paths(spark):
    e = spark.createDataFrame([(None, "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "p string, c string")
    got = sorted((r.vertex_count, r.multiple_paths, r.level1, r.level2, r.level3, r.level15) for r in T.flatten_hierarchy(e, "p", "c").collect())
    assert got == [(3, True, "a", "b", "d", "d"), (3, True, "a", "c", "d", "d")]
    assert T.flatten_hierarchy(e, "p", "c", all_levels=True).count() == 5
    with pytest.raises(ValueError):
        T.flatten_hierarchy(e.union(spark.createDataFrame([("d", "a")], "p string, c string")), "p", "c").collect()


def test_penultimate(spark):
    rows = [("o", 1, "open", 10), ("o", 2, "open", 20), ("o", 3, "won", 20), ("p", 1, "open", 5)]
    df = spark.createDataFrame(rows, "id string, t int, stage string, amount int")
    got = {r["id"]: tuple(r)[1:] for r in T.penultimate_values(df, ["id"], "t", "stage", ["amount"]).collect()}
    assert got == {"o": (1, "open", 10, 3), "p": (1, None, None, 1)}


def test_constraints(spark):
    df = spark.createDataFrame([(1, None), (2, "W"), (3, "R"), (4, "?")], "k int, code string")
    kept, rejected = T.enforce_constraints(df, ["code"], {"W": "warning", "R": "reject"})
    assert sorted(r.k for r in kept.collect()) == [1, 2, 4] and [r.k for r in rejected.collect()] == [3]
    with pytest.raises(Exception):  # noqa: B017
        T.enforce_constraints(df, ["code"], {"R": "fatal"})[0].collect()


def test_pivot_needs_one_row(spark):
    with pytest.raises(ValueError):
        T.pivot_columns_to_rows(spark.range(2))


def test_versions_labels(spark, tmp_path):
    t = dml.VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.label("first")
    t.merge(spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    t.update(F.col("k") == 1, {"v": F.upper("v")})
    assert sorted(map(tuple, t.read().collect())) == [(1, "A"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, t.read(label="first").collect())) == [(1, "a"), (2, "b")]
    assert t.vacuum() == 1 and t.read(label="first").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        t.merge(spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string"), ["k"])
    t.add_column("w", F.lit(0))
    t.truncate()
    assert t.read().columns == ["k", "v", "w"] and t.read().count() == 0


def test_flat_file(spark, tmp_path):
    (tmp_path / "f.txt").write_text('k,v,d\n1,"a,b",2001-02-03\n2,x\nz,y,2001-01-01\n')
    schema = flatfile.parse_bcp('6.0\n3\n1 SQLINT 0 0 "," 1 k\n2 SQLVARCHAR 0 9 "," 2 v\n3 SQLDATE 0 0 "\\n" 3 d\n')
    rows, bad = flatfile.read(spark, f"file://{tmp_path}/f.txt", schema)
    assert sorted((r.k, r.v) for r in rows.collect()) == [(1, "a,b"), (2, "x")] and bad.count() == 1
    rows, bad = flatfile.read(spark, f"file://{tmp_path}/f.txt", schema, lenient=False)
    assert rows.count() == 1 and bad.count() == 2
    assert flatfile.parse_bcp(flatfile.bcp_of(schema)) == schema


def test_catalog(spark, sf_dir):
    got = {r.column_name: r for r in catalog.analyze(spark.read.parquet(f"{sf_dir}/nation.parquet")).collect()}
    assert got["n_nationkey"].rows == 25 and got["n_nationkey"].nulls == 0 and got["n_regionkey"].low == "0"


def test_analyze_counts_all_rows_in_bars(spark):
    df = spark.range(1000).selectExpr("id", "id / 4 AS x", "date_add(DATE'2020-01-01', CAST(id % 7 AS INT)) AS d", "IF(id < 10, NULL, CAST(id % 3 AS DECIMAL(9,2))) AS m", "'a' AS s")
    got = {r.column_name: r.histogram for r in catalog.analyze(df, bins=8).collect()}
    assert {c: sum(b.y for b in got[c]) for c in ("id", "x", "d", "m")} == {"id": 1000, "x": 1000, "d": 1000, "m": 990}
    assert len(got["id"]) == 8 and len(got["d"]) <= 8 and len(got["m"]) <= 8 and got["s"] is None


def test_range_join_has_no_product(spark):
    a, b = spark.range(10).withColumn("x", F.col("id") * 1.0), spark.createDataFrame([(0.0, 3.0), (8.5, 20.0)], "lo double, hi double")
    df = R.range_join(a, b, "x", "lo", "hi", 4.0)
    assert df.count() == 4 and "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_range_join_takes_all_parts(spark, tmp_path):
    rnd = random.Random(4)
    parts = [(k, rnd.randint(9000, 9200) / 10) for k in range(0, 1000, 7)]
    orders = [(k, rnd.randint(89000, 93000) * 1.0) for k in range(300)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted((o, p) for o, at in orders for p, low in parts if low <= at / 100 < low + 5)
    assert any(p >= 200 for _, p in want)
    assert sorted(tuple(r) for r in QUERIES["join_range_binned"](spark, f"file://{tmp_path}").collect()) == want


def test_stream(spark, tmp_path, sf_dir):
    e = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = windows.tumbling_counts(e, "ts", ["event_type"], "1 day", "1 hour").writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == 1000
