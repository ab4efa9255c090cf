"""Versioned tables: writers side by side, merges, files, constraints."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import dml
from millrace.operators import table_functions as TF


@pytest.fixture
def table(spark, tmp_path):
    t = dml.VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.createDataFrame([(i, f"n{i}") for i in range(10)], "k int, v string").repartitionByRange(5, "k"), -1)
    return t


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_no_update_is_lost(spark, table):
    """Two writers read one version: the second to commit is told, and its insert is done on the newer version."""
    base = table.version
    new = spark.createDataFrame([(100, "a")], "k int, v string")
    table.insert(new)
    with pytest.raises(dml.Conflict):
        table.delete(F.col("k") == 1, base)
    with pytest.raises(dml.Conflict):
        table.update(F.col("k") == 1, {"v": F.lit("x")}, base)
    with pytest.raises(dml.Conflict):
        table.merge(new, ["k"], base=base)
    with pytest.raises(dml.Conflict):
        table.commit(new, base)
    assert table.read().count() == 11
    log, seen = table._log, []

    def late(*a):
        if not seen:
            seen.append(1)
            dml.VersionedTable(spark, table.path).insert(spark.createDataFrame([(200, "b")], "k int, v string"))
        return log(*a)

    table._log = late
    table.insert(spark.createDataFrame([(300, "c")], "k int, v string"))
    assert {200, 300} <= {r.k for r in table.read().collect()} and table.read().count() == 13


def test_a_log_entry_is_whole(spark, table):
    names = table._names("log")
    assert names == ["000000000000"] and table._entry(0)["files"]
    with pytest.raises(dml.Conflict):
        table._put("log/000000000000", "other")
    assert table._names("log") == names and len(table._entry(0)["files"]) == 5


def test_statements_touch_files_that_they_hit(spark, table):
    before = set(table._entry(table.version)["files"])
    table.insert(spark.createDataFrame([(50, "new")], "k int, v string"))
    assert before < set(table._entry(table.version)["files"])
    table.delete(F.col("k") == 0)
    assert len(before & set(table._entry(table.version)["files"])) == 4
    table.update(F.col("k") == 9, {"v": F.lit("z")})
    assert len(before & set(table._entry(table.version)["files"])) == 3
    table.delete(F.col("k") == 12345)
    assert len(before & set(table._entry(table.version)["files"])) == 3
    assert rows(table.read()) == sorted([*((i, f"n{i}") for i in range(1, 9)), (9, "z"), (50, "new")], key=str)
    table.label("now")
    table.rebuild(1)
    table.truncate()
    assert table.read().count() == 0 and table.read(label="now").count() == 10
    table.vacuum()
    assert table.read(label="now").count() == 10
    with pytest.raises(dml.Conflict):
        table.label("now")


def test_merge_of_null_and_unmatched_keys(spark, table):
    source = spark.createDataFrame([(None, "p"), (None, "q"), (70, "r"), (70, "s"), (3, "t")], "k int, v string")
    table.merge(source, ["k"])
    got = rows(table.read())
    assert got == sorted([(None, "p"), (None, "q"), (70, "r"), (70, "s"), (3, "t"), *((i, f"n{i}") for i in range(10) if i != 3)], key=str)
    twice = spark.createDataFrame([(4, "a"), (4, "b")], "k int, v string")
    with pytest.raises(Exception, match="21000"):
        table.merge(twice, ["k"])
    assert rows(table.read()) == got
    assert rows(dml.merged(table.read(), twice, ["k"], update=[])) == got
    table.merge(twice.where("v = 'a'"), ["k"], update={"v": F.concat("t.v", F.lit("-"), "s.v")}, insert=False)
    assert ("4", "n4-a") in {(str(r.k), r.v) for r in table.read().collect()}
    assert dml.merged(table.read().limit(0), source, ["k"]).count() == 5


def test_constraints(spark, table):
    bad = spark.createDataFrame([(1, "x"), (None, "y"), (20, None)], "k int, v string")
    good, log = dml.with_error_log(bad, {"key": F.col("k").isNotNull(), "text": F.col("v").isNotNull(), "new": F.col("k") > 5})
    assert rows(good) == [] and sorted((r.row.v or "", r.errors) for r in log.collect()) == [("", ["text"]), ("x", ["new"]), ("y", ["key", "new"])]
    with pytest.raises(ValueError, match="more than 1"):
        dml.with_error_log(bad, {"key": F.col("k") > 100}, error_max=1)
    new = spark.createDataFrame([(30, "a"), (31, "b")], "k int, v string")
    assert dml.unique_rows(table.read(), new, ["k"]).count() == 2
    for rows_, text in ((new.unionByName(new), "23505"), (table.read().limit(1), "23505"), (bad.where("k IS NULL"), "23502")):
        with pytest.raises(Exception, match=text):
            dml.unique_rows(table.read(), rows_, ["k"]).collect()


def test_sequence(spark):
    d = spark.range(6).withColumnRenamed("id", "k")
    s = TF.Sequence(5, -2, low=1, cycle=True)
    assert [r.id for r in s.assign(d, ["k"], "id").orderBy("k").collect()] == [5, 3, 1, 5, 3, 1]
    s = TF.Sequence(1, 1, high=8)
    assert [r.id for r in s.assign(d, ["k"], "id").orderBy("k").collect()] == [1, 2, 3, 4, 5, 6]
    assert [r.id for r in s.assign(d.limit(2), ["k"], "id").orderBy("k").collect()] == [7, 8]
    with pytest.raises(Exception, match="2200H"):
        s.assign(d, ["k"], "id").collect()


def test_defined_table(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("id", "long").add("k", "integer").add("v", "string").add("w", "string")
    t = dml.DefinedTable(spark, str(tmp_path / "d"), schema, {"w": F.lit("d")}, ("v",), ("k",), ("id", TF.Sequence(10, 5), ["k"]))
    t.insert(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"))
    t.insert(spark.createDataFrame([(3, "c")], "k int, v string"))
    want = [(10, 1, "a", "d"), (15, 2, "b", "d"), (20, 3, "c", "d")]
    assert sorted(tuple(r) for r in t.read().collect()) == want
    for bad, text in (((1, "x"), "23505"), ((9, None), "23502"), ((None, "x"), "23502")):
        with pytest.raises(Exception, match=text):
            t.insert(spark.createDataFrame([bad], "k int, v string"))
    assert sorted(tuple(r) for r in t.read().collect()) == want


def test_savepoint_and_backup(spark, table, tmp_path):
    table.label("a")
    table.truncate()
    copy = table.backup(str(tmp_path / "copy"), "a")
    assert table.read().count() == 0 and copy.read().count() == 10
    table.restore("a")
    assert table.read().count() == 10
