"""Procedures on a schema of their own."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import procedures as P


@pytest.fixture
def schema(spark, tmp_path):
    spark.sql(f"CREATE SCHEMA staging_t LOCATION '{tmp_path}'")
    yield "staging_t"
    P.drop_schema_if_exists(spark, "staging_t", cascade=True)


def test_tables_of_a_schema(spark, schema):
    df = spark.range(5).withColumn("s", F.lit("x"))
    P.create_table_as(df, schema, "a")
    P.create_table_as(df, schema, "b", with_rows=False)
    P.create_table_like(spark, "staging_t.a", schema, "c", {"extra": "double"})
    assert [spark.table(f"staging_t.{t}").count() for t in "abc"] == [5, 0, 0]
    assert spark.table("staging_t.c").columns == ["id", "s", "extra"]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        P.create_table_as(df, schema, "a")
    assert P.compute_statistics(spark, schema) == ["a", "b", "c"]
    assert not P.execute_if_no_rows(spark, "SELECT * FROM staging_t.a", "DROP TABLE staging_t.b")
    assert P.execute_if_no_rows(spark, "SELECT * FROM staging_t.b", "DROP TABLE staging_t.b")
    with pytest.raises(Exception, match="(?i)not.?empty"):
        P.drop_schema_if_exists(spark, schema)


def test_ddl_and_advice(spark):
    assert P.ddl_of(spark.range(1), "t") == "CREATE TABLE `t` (\n  `id` BIGINT NOT NULL\n)"
    assert P.sql_problem(spark, "SELECT 1") is None
    assert "SYNTAX" in P.sql_problem(spark, "SELECT 1 +")
    assert "nowhere_t" in P.sql_problem(spark, "SELECT a FROM nowhere_t")


def test_functions_and_variables(spark):
    P.sql_function(spark, "add_or_zero", "x INT, y INT", "INT", "coalesce(x, 0) + coalesce(y, 0)")
    P.sql_function(spark, "add_strict", "x INT, y INT", "INT", "coalesce(x, 0) + coalesce(y, 0)", null_on_null=True)
    assert tuple(spark.sql("SELECT add_or_zero(1, NULL), add_strict(1, NULL), add_strict(1, 2)").first()) == (1, None, 3)
    v = P.Variables()
    v.create("load", "day")
    assert spark.range(1).select(v.get("load", "day")).first()[0] is None
    v.set("load", "day", "d1")
    assert spark.range(1).select(v.get("load", "day")).first()[0] == "d1"
    for bad in (lambda: v.create("load", "day"), lambda: v.create("no-name")):
        with pytest.raises(ValueError):
            bad()
    v.delete("load", "day")
    with pytest.raises(KeyError):
        v.set("load", "day", "d2")
