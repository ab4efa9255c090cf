"""Queries of loading and changing data: files, DML, constraints, catalogs, routines, streams, partitioned tables.

What a query needs on disk it writes below the shared folder, under a name of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import dml, procedures, relational
from millrace.operators import table_functions as TF
from millrace.plans.registry import query
from millrace.plans.sql import load, register
from millrace.sources import catalog, flatfile, partitioned
from millrace.streaming import windows


def fresh(spark, name: str) -> str:
    return f"{TF.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Flat files: a table goes out as text and comes back
def _exported(spark, sf_dir, field=",", header=True):
    path = fresh(spark, "nation")
    flatfile.export(load(spark, sf_dir, "nation"), path, field, header)
    return path


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(_NATION)
def flatfile_inferred(spark, sf_dir):
    """Names from the header, types from the first rows."""
    return flatfile.read(spark, _exported(spark, sf_dir), sample_rows=5)[0]


@query(_NATION)
def flatfile_control_file(spark, sf_dir):
    """No header: names and types come from a control file."""
    path = _exported(spark, sf_dir, "\t", header=False)
    schema = flatfile.parse_bcp(flatfile.bcp_of(load(spark, sf_dir, "nation").schema, "\t"))
    return flatfile.read(spark, path, schema, field="\t", header=False)[0]


@query("SELECT n_regionkey, n_name, CAST(NULL AS VARCHAR) AS n_comment FROM nation")
def flatfile_mapped(spark, sf_dir):
    """Fields are found by the header's names; a column that the file lacks is null."""
    schema = T.StructType().add("n_regionkey", "integer").add("n_name", "string").add("n_comment", "string")
    return flatfile.read(spark, _exported(spark, sf_dir), schema, mapped=True)[0]


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 1 THEN n_name END AS n_name, CASE WHEN n_nationkey % 5 > 1 THEN n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey % 5 <> 4")
def flatfile_lenient(spark, sf_dir):
    """Rows with too few fields are filled up, further fields go; row 4 of 5 has a text for a number and is rejected."""
    return _ragged(spark, sf_dir, True)[0]


@query("SELECT CAST(count(*) AS BIGINT) AS good, (SELECT count(*) FROM nation) - count(*) AS bad FROM nation WHERE n_nationkey % 5 = 2")
def flatfile_strict(spark, sf_dir):
    """Only rows with as many fields as columns are good."""
    good, bad = _ragged(spark, sf_dir, False)
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad")))


def _ragged(spark, sf_dir, lenient):
    k, n, r = F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")
    text = F.when(k % 5 == 0, F.concat_ws(",", k, n)).when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat_ws(",", k, n, r)).when(k % 5 == 3, F.concat_ws(",", k, n, r, F.lit("more"))).otherwise(F.concat_ws(",", F.lit("x"), n, r))
    path = fresh(spark, "ragged")
    load(spark, sf_dir, "nation").select(text).write.text(path)
    schema = T.StructType().add("n_nationkey", "integer").add("n_name", "string").add("n_regionkey", "integer")
    return flatfile.read(spark, path, schema, header=False, lenient=lenient)


@query("SELECT 'x,' || n_name || ',' || n_regionkey AS line FROM nation WHERE n_nationkey % 5 = 4")
def flatfile_rejects(spark, sf_dir):
    return _ragged(spark, sf_dir, True)[1]


@query("SELECT r_regionkey, n_name, r_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def export_query(spark, sf_dir):
    """A query's rows go to a file with a header and a control file, and are read by it."""
    path = fresh(spark, "query")
    rows = spark.sql("SELECT r_regionkey, n_name, r_name FROM {region} JOIN {nation} ON n_regionkey = r_regionkey", region=load(spark, sf_dir, "region"), nation=load(spark, sf_dir, "nation"))
    return flatfile.read(spark, *flatfile.export_with_schema(rows, path))[0]


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def export_schema(spark, sf_dir):
    """Each table of a list goes to a folder of its own."""
    folder = fresh(spark, "schema")
    names = ["nation", "region"]
    for n in names:
        flatfile.export_with_schema(load(spark, sf_dir, n), f"{folder}/{n}")
    counts = [flatfile.read(spark, f"{folder}/{n}/data", header=True)[0].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in names]
    return counts[0].unionByName(counts[1])


# DML on versioned tables
def _table(spark, df):
    t = dml.VersionedTable(spark, fresh(spark, "versioned"))
    t.commit(df, -1)
    return t


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 0")
def dml_versioned_insert_label(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    t = _table(spark, n)
    t.insert(n.where("n_regionkey = 0").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    t.label("after_insert")
    t.delete(F.col("n_regionkey") == 4)
    return t.read(label="after_insert")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 3")
def dml_file_level(spark, sf_dir):
    """A table in five files: an update and a delete rewrite only the files that they hit."""
    n = load(spark, sf_dir, "nation").repartitionByRange(5, "n_regionkey")
    t = _table(spark, n)
    t.delete(F.col("n_regionkey") == 3)
    t.update(F.col("n_regionkey") == 1, {"n_name": F.lower("n_name")})
    return t.read()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT n_nationkey, n_name || '+' || n_regionkey, 0 FROM nation WHERE n_nationkey < 10 UNION ALL SELECT NULL, n_name, -1 FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 500, n_name, -1 FROM nation WHERE n_nationkey IN (1, 2)")
def dml_merge_general(spark, sf_dir):
    """Expressions over both sides in SET, others in INSERT; null keys and repeated keys without a match are inserted."""
    n = load(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    source = n.where(k < 10).select("n_nationkey", "n_name", "n_regionkey").unionByName(n.where(k > 20).withColumn("n_nationkey", F.lit(None).cast("int"))).unionByName(n.where(k.isin(1, 2)).withColumn("n_nationkey", F.lit(500)))
    t = _table(spark, n)
    t.merge(source, ["n_nationkey"], update={"n_name": F.concat("t.n_name", F.lit("+"), F.col("s.n_regionkey").cast("string")), "n_regionkey": F.lit(0)}, insert={"n_nationkey": F.col("s.n_nationkey"), "n_name": F.col("s.n_name"), "n_regionkey": F.lit(-1)})
    return t.read()


@query("SELECT 'matched twice' AS name, true AS raised UNION ALL SELECT 'not matched', false UNION ALL SELECT 'null keys', false")
def dml_merge_cardinality(spark, sf_dir):
    """Only a target row with several source rows is an error."""
    n = load(spark, sf_dir, "nation")
    out = []
    for name, key in (("matched twice", F.lit(1)), ("not matched", F.lit(900)), ("null keys", F.lit(None).cast("int"))):
        twice = n.where("n_nationkey < 2").withColumn("n_nationkey", key)
        try:
            dml.merged(n, twice, ["n_nationkey"]).collect()
            out.append((name, False))
        except Exception:  # noqa: BLE001 the error of the merge
            out.append((name, True))
    return spark.createDataFrame(out, "name string, raised boolean")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE false")
def dml_truncate(spark, sf_dir):
    t = _table(spark, load(spark, sf_dir, "nation"))
    t.truncate()
    return t.read().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey, 'none' AS n_comment FROM nation")
def dml_add_column(spark, sf_dir):
    t = _table(spark, load(spark, sf_dir, "nation"))
    t.add_column("n_comment", F.lit("none"))
    return t.read()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dml_rebuild(spark, sf_dir):
    t = _table(spark, load(spark, sf_dir, "nation").repartition(8))
    t.rebuild(1)
    t.vacuum()
    return t.read()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 AND n_name > 'C'")
def dml_error_log(spark, sf_dir):
    """Rows that break a rule go to the log."""
    rules = {"region": F.col("n_regionkey") != 2, "name": F.col("n_name") > "C"}
    return dml.with_error_log(load(spark, sf_dir, "nation"), rules, error_max=1000)[0]


@query("SELECT n_nationkey, [x FOR x IN [CASE WHEN n_regionkey = 2 THEN 'region' END, CASE WHEN n_name <= 'C' THEN 'name' END] IF x IS NOT NULL] AS errors FROM nation WHERE n_regionkey = 2 OR n_name <= 'C'")
def dml_error_log_rows(spark, sf_dir):
    rules = {"region": F.col("n_regionkey") != 2, "name": F.col("n_name") > "C"}
    return dml.with_error_log(load(spark, sf_dir, "nation"), rules)[1].select("row.n_nationkey", "errors")


@query("SELECT n_nationkey, n_name, 7 AS n_regionkey FROM nation")
def dml_defaults(spark, sf_dir):
    """Columns that an INSERT does not name have their defaults."""
    n = load(spark, sf_dir, "nation")
    return dml.conformed(n.select("n_name", "n_nationkey"), n.schema, {"n_regionkey": F.lit(7)})


@query("SELECT 'twice' AS name, true AS raised UNION ALL SELECT 'in the table', true UNION ALL SELECT 'null', true UNION ALL SELECT 'new', false")
def dml_primary_key(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    out = []
    for name, rows in (("twice", n.unionByName(n).withColumn("n_nationkey", F.col("n_nationkey") + 100)), ("in the table", n.where("n_nationkey = 3")), ("null", n.withColumn("n_nationkey", F.lit(None).cast("int"))), ("new", n.withColumn("n_nationkey", F.col("n_nationkey") + 100))):
        try:
            dml.unique_rows(n, rows, ["n_nationkey"]).collect()
            out.append((name, False))
        except Exception:  # noqa: BLE001 the error of the constraint
            out.append((name, True))
    return spark.createDataFrame(out, "name string, raised boolean")


@query("SELECT o_orderkey, 1000 + 10 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id FROM orders")
def sequence_next_value(spark, sf_dir):
    """NEXT VALUE FOR a sequence with start and increment; the sequence knows where the next statement goes on."""
    s = TF.Sequence(1000, 10)
    return s.assign(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "id")


@query("SELECT k, CAST(CASE WHEN k <= 5 THEN 5 + 2 * k ELSE 5 + 2 * (k - 5) END AS BIGINT) AS id FROM (SELECT n_nationkey + 1 AS k FROM nation WHERE n_nationkey < 8)")
def sequence_cycle(spark, sf_dir):
    """A cycle begins at the minimum again."""
    s = TF.Sequence(7, 2, low=7, high=15, cycle=True)
    return s.assign(load(spark, sf_dir, "nation").where("n_nationkey < 8").select((F.col("n_nationkey") + 1).alias("k")), ["k"], "id")


@query("SELECT row_number() OVER (ORDER BY n_name) AS id, n_name, 'none' AS note, n_nationkey AS k FROM nation")
def table_definition(spark, sf_dir):
    """Defaults, an identity, a key and a column that must not be null."""
    schema = T.StructType().add("id", "long").add("n_name", "string").add("note", "string").add("k", "integer")
    t = dml.DefinedTable(spark, fresh(spark, "defined"), schema, {"note": F.lit("none")}, ("n_name",), ("k",), ("id", TF.Sequence(), ["n_name"]))
    t.insert(load(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("k")))
    return t.read()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def dml_savepoint_rollback(spark, sf_dir):
    t = _table(spark, load(spark, sf_dir, "nation"))
    t.delete(F.col("n_regionkey") == 1)
    t.label("savepoint")
    t.update(F.lit(True), {"n_name": F.lit("lost")})
    t.truncate()
    t.restore("savepoint")
    return t.read()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def dml_backup_restore(spark, sf_dir):
    """A backup stays as it was, whatever happens to the table."""
    t = _table(spark, load(spark, sf_dir, "nation"))
    t.delete(F.col("n_regionkey") == 1)
    copy = t.backup(fresh(spark, "backup"))
    t.truncate()
    return copy.read()


@query("SELECT 'second writer' AS name, true AS raised, count(*) AS n FROM nation WHERE n_regionkey <> 1")
def dml_conflict(spark, sf_dir):
    """Two deletes that read one version: the second is told of the first."""
    t = _table(spark, load(spark, sf_dir, "nation"))
    base = t.version
    t.delete(F.col("n_regionkey") == 1, base)
    try:
        t.delete(F.col("n_regionkey") == 2, base)
        raised = False
    except dml.Conflict:
        raised = True
    return t.read().agg(F.lit("second writer").alias("name"), F.lit(raised).alias("raised"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) AS ids, true AS from_zero FROM orders")
def row_ids(spark, sf_dir):
    """Row ids of a scan: file and place in it."""
    o = load(spark, sf_dir, "orders").select(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("f", "i").alias("ids"), (F.min("i") == 0).alias("from_zero"))


# Catalog
_TABLES = ["customer", "nation", "orders", "region"]


@query("SELECT table_name FROM information_schema.tables WHERE table_name IN ('customer', 'nation', 'orders', 'region')")
def catalog_tables(spark, sf_dir):
    """Views of an imported folder, as the catalog lists them."""
    prefix = f"imported_{uuid.uuid4().hex}_"
    catalog.import_schema(spark, sf_dir, _TABLES, prefix)
    names = [n[len(prefix) :] for n, _, _ in catalog.tables(spark) if n.startswith(prefix)]
    for n in names:
        spark.catalog.dropTempView(prefix + n)
    return spark.createDataFrame([(n,) for n in names], "table_name string")


@query("SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'orders', 'region')")
def catalog_columns(spark, sf_dir):
    rows = [(t, c, i) for t in _TABLES for i, (c, _, _) in enumerate(catalog.columns_of(load(spark, sf_dir, t)), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int")


@query("SELECT 'customer' AS name UNION ALL SELECT 'orders'")
def import_schema_except(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in catalog.chosen(_TABLES, except_=["n%", "region"])], "name string")


@query("SELECT column_name, row_count, nulls, distinct_count FROM (SELECT 'n_regionkey' AS column_name, count(*) AS row_count, 0 AS nulls, count(DISTINCT n_regionkey) AS distinct_count FROM nation UNION ALL SELECT 'n_name', count(*), 0, count(DISTINCT n_name) FROM nation)")
def analyze_table(spark, sf_dir):
    s = catalog.analyze(load(spark, sf_dir, "nation").select("n_regionkey", "n_name"))
    return s.select("column_name", F.col("rows").alias("row_count"), F.col("nulls").cast("int").alias("nulls"), F.col("distinct").alias("distinct_count"))


@query("SELECT * FROM (VALUES ('mock_int', 1000), ('mock_text', 1000)) t(column_name, n)")
def mock_source(spark, sf_dir):
    """Rows made from a schema and a count alone; a text is as long as its column allows."""
    rows = catalog.mock(spark, T.StructType().add("mock_int", "integer").add("mock_text", "string"), 1000)
    return rows.agg(F.count("mock_int").cast("int").alias("mock_int"), F.count("mock_text").cast("int").alias("mock_text")).select(F.expr("stack(2, 'mock_int', mock_int, 'mock_text', mock_text) AS (column_name, n)"))


@query("SELECT true AS has_scan, true AS has_filter, true AS pushed")
def explain_plan(spark, sf_dir):
    text = procedures.plan_of(load(spark, sf_dir, "orders").where("o_orderkey = 77").select("o_orderkey"))
    return spark.createDataFrame([("Scan parquet" in text or "FileScan parquet" in text, "Filter" in text, "EqualTo(o_orderkey,77)" in text)], "has_scan boolean, has_filter boolean, pushed boolean")


@query("SELECT true AS one_sort")
def redundant_sort(spark, sf_dir):
    """A sort below another sort, or below an aggregate, is not done."""
    o = load(spark, sf_dir, "orders")
    text = procedures.plan_of(o.orderBy("o_totalprice").orderBy("o_orderkey").select("o_orderkey"))
    return spark.createDataFrame([(text.count("\n(") > 0 and text.count("Sort [") + text.count(") Sort") <= 2 and "o_totalprice#" not in text.split("Sort")[-1].split("\n")[0],)], "one_sort boolean")


@query("SELECT * FROM (VALUES ('good', true), ('no table', false), ('syntax', false)) t(name, fine)")
def sql_advisor(spark, sf_dir):
    cases = {"good": "SELECT 1", "no table": "SELECT * FROM no_such_table_here", "syntax": "SELEC 1"}
    return spark.createDataFrame([(k, procedures.sql_problem(spark, v) is None) for k, v in cases.items()], "name string, fine boolean")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def ddl_views(spark, sf_dir):
    """CREATE, CREATE OR REPLACE and DROP of views, one over the other."""
    a, b = (f"v_{uuid.uuid4().hex}" for _ in range(2))
    load(spark, sf_dir, "nation").createOrReplaceTempView(a)
    spark.sql(f"CREATE TEMPORARY VIEW {b} AS SELECT n_name, n_regionkey FROM {a} WHERE n_regionkey = 0")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {b} AS SELECT n_name FROM {a} WHERE n_regionkey = 1")
    out = spark.sql(f"SELECT n_name FROM {b}")
    spark.sql(f"DROP VIEW {b}")
    spark.sql(f"DROP VIEW {a}")
    return out


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def foreign_server(spark, sf_dir):
    """Tables of two servers, one of Parquet and one of text files."""
    servers, path = procedures.Servers(), fresh(spark, "region")
    flatfile.export(load(spark, sf_dir, "region"), path)
    servers.create("lake", lambda name: load(spark, sf_dir, name))
    servers.create("files", lambda name: flatfile.read(spark, path)[0])
    return servers.table("lake", "nation").join(servers.table("files", "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT * FROM (VALUES ('inside', '3'), ('after', 'as before')) t(name, value)")
def session_parameters(spark, sf_dir):
    """ALTER SESSION SET holds for a block."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with procedures.settings(spark, spark__sql__shuffle__partitions="3"):
        inside = spark.conf.get(key)
    return spark.createDataFrame([("inside", inside), ("after", "as before" if spark.conf.get(key) == before else "changed")], "name string, value string")


@query("SELECT 'killed' AS outcome")
def kill_statement(spark, sf_dir):
    """A statement that would run for long is killed by its tag."""
    import threading
    import time

    tag, out = f"kill-{uuid.uuid4().hex}", []

    def run():
        try:
            procedures.tagged(spark, tag, lambda: spark.range(10**12).selectExpr("sum(id * id % 7)").collect())
            out.append("ended")
        except Exception:  # noqa: BLE001 the error of a cancelled job
            out.append("killed")

    t = threading.Thread(target=run)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        procedures.kill(spark, tag)
        if not t.is_alive():
            break
    t.join(60)
    return spark.createDataFrame([(out[0],)], "outcome string")


@query("SELECT 'o_orderstatus' AS column_name, count(DISTINCT o_orderstatus) AS keys, count(*) AS n FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders")
def create_indexes(spark, sf_dir):
    """Bitmap indexes for all columns of few values."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    out = [i.agg(F.lit(c).alias("column_name"), F.count_distinct("key").alias("keys"), F.sum(F.bitmap_count("bitmap")).alias("n")) for c, i in sorted(procedures.create_indexes(o, "o_orderkey", 1).items())]
    return out[0].unionByName(out[1]) if len(out) == 2 else out[0]


# Remote databases: one that every process can read stands for them
def _remote(spark, sf_dir):
    return catalog.packed_database(spark, {t: load(spark, sf_dir, t) for t in ("nation", "region")})


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 10 AND n_regionkey = 2")
def jdbc_query(spark, sf_dir):
    """Filters on a remote query go to the remote side."""
    rows = catalog.jdbc(spark, _remote(spark, sf_dir), 'SELECT "n_nationkey", "n_name", "n_regionkey" FROM nation')
    return rows.where("n_nationkey > 10 AND n_regionkey = 2").select("n_name", "n_regionkey")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
def jdbc_join_push_down(spark, sf_dir):
    """A join of two remote tables is done there."""
    return catalog.jdbc(spark, _remote(spark, sf_dir), 'SELECT n."n_name", r."r_name", r."r_regionkey" FROM nation n JOIN region r ON n."n_regionkey" = r."r_regionkey"').where("r_regionkey = 2").select("n_name", "r_name")


# Routines
@query("SELECT n_nationkey, n_nationkey * 10 + coalesce(n_regionkey, 0) AS v FROM nation")
def routine_sql(spark, sf_dir):
    name = f"code_{uuid.uuid4().hex[:8]}"
    procedures.sql_function(spark, name, "a INT, b INT", "INT", "a * 10 + b")
    return spark.sql(f"SELECT n_nationkey, {name}(n_nationkey, n_regionkey) AS v FROM {{nation}}", nation=load(spark, sf_dir, "nation"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_regionkey + 5 END AS v FROM nation")
def routine_null_on_null(spark, sf_dir):
    name = f"plus_{uuid.uuid4().hex[:8]}"
    procedures.sql_function(spark, name, "a INT", "INT", "coalesce(a, 100) + 5", null_on_null=True)
    return spark.sql(f"SELECT n_nationkey, {name}(NULLIF(n_regionkey, 1)) AS v FROM {{nation}}", nation=load(spark, sf_dir, "nation"))


@query("SELECT n_nationkey, 'text:' || n_name AS a, n_regionkey + 1 AS b FROM nation")
def routine_overloads(spark, sf_dir):
    """One name, chosen by the types of the arguments."""
    r = procedures.Routines()
    r.add("tag", ["string"], lambda x: F.concat(F.lit("text:"), x))
    r.add("tag", ["int"], lambda x: x + 1)
    n = load(spark, sf_dir, "nation")
    return n.select("n_nationkey", r.call(n, "tag", "n_name").alias("a"), r.call(n, "tag", "n_regionkey").alias("b"))


@query("SELECT o_custkey, round(sum(o_totalprice * o_orderkey) / sum(o_orderkey), 4) AS w FROM orders GROUP BY o_custkey")
def user_aggregate(spark, sf_dir):
    """An aggregate of the user's own, made of the engine's: it combines map-side."""
    weighted = procedures.aggregate(lambda x, w: {"a": F.sum(x * w), "b": F.sum(w)}, lambda s: s["a"] / s["b"])
    return weighted(load(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_totalprice"), F.col("o_orderkey"), name="w").select("o_custkey", F.round("w", 4).alias("w"))


@query("SELECT n_nationkey, CAST(i AS INTEGER) AS i, substr(n_name, i, 1) AS c FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
def user_table_function(spark, sf_dir):
    """A table function over a cursor, with an argument, by Arrow batches."""
    def letters(rows, at):
        for f in rows:
            f = f.assign(c=f["n_name"].map(list)).explode("c")
            f["i"] = f.groupby("n_nationkey").cumcount() + at
            yield f[["n_nationkey", "i", "c"]]

    return procedures.table_function(letters, "n_nationkey int, i int, c string")(load(spark, sf_dir, "nation"), at=1)


@query("SELECT count(*) AS n, count(*) // 2 AS half FROM nation")
def procedure_call(spark, sf_dir):
    """CALL of a procedure with in and out parameters."""
    p = procedures.Procedures()
    p.add("count_rows", lambda spark, df, share: {"n": df.count(), "half": df.count() // share})
    out = p.call(spark, "count_rows", load(spark, sf_dir, "nation"), share=2)
    return spark.createDataFrame([(out["n"], out["half"])], "n long, half long")


@query("SELECT page_id, lower(t[2:]) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z][A-Za-z0-9]*')) AS t FROM pages) GROUP BY 1, 2")
def html_tokens(spark, sf_dir):
    tags = F.explode(F.expr("regexp_extract_all(html, '<[A-Za-z][A-Za-z0-9]*', 0)"))
    t = load(spark, sf_dir, "pages").select("page_id", tags.alias("t")).select("page_id", F.lower(F.expr("substring(t, 2)")).alias("tag"))
    return t.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


# ETL procedures
@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def create_table_as(spark, sf_dir):
    path = fresh(spark, "made")
    procedures.create_table_at(load(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name"), path)
    return spark.read.parquet(path)


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def for_entire_schema(spark, sf_dir):
    """One statement for each table of a list."""
    out = [spark.sql("SELECT '%s' AS name, count(*) AS n FROM {t}" % n, t=load(spark, sf_dir, n)) for n in ("nation", "region")]
    return out[0].unionByName(out[1])


@query("SELECT * FROM (VALUES ('no rows', true), ('rows', false)) t(name, ran)")
def exec_sql_if_no_rows(spark, sf_dir):
    return spark.createDataFrame([("no rows", procedures.execute_if_no_rows(spark, "SELECT 1 WHERE false", "SELECT 2")), ("rows", procedures.execute_if_no_rows(spark, "SELECT 1", "SELECT 2"))], "name string, ran boolean")


@query("SELECT 'CREATE TABLE `nation` (' AS first, 3 AS columns")
def ddl_generation(spark, sf_dir):
    lines = procedures.ddl_of(load(spark, sf_dir, "nation"), "nation").splitlines()
    return spark.createDataFrame([(lines[0], len(lines) - 2)], "first string, columns int")


# Partitioned and replicated tables
@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')")
def partitioned_table(spark, sf_dir):
    """A table is the union of its partitions; a filter on the partitioning column reads only those that it names."""
    t = partitioned.PartitionedTable(spark, fresh(spark, "parts"), "o_orderstatus")
    t.write(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return t.read().where("o_orderstatus IN ('F', 'P')").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderstatus, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def replica_join(spark, sf_dir):
    """A replicated table goes to every partition whole if its size allows, and is shuffled if not."""
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = partitioned.replica_join(o, load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("o_orderstatus", "n_name").agg(F.count(F.lit(1)).alias("n"))


# Joins of ranges and periods
@query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice / 100 >= p_retailprice AND o_totalprice / 100 < p_retailprice + CASE WHEN p_partkey % 100 = 0 THEN 200 ELSE 2 END")
def join_range_long(spark, sf_dir):
    """Most ranges are short, some a hundred times as long."""
    points = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    width = F.when(F.col("p_partkey") % 100 == 0, 200).otherwise(2)
    ranges = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + width).alias("high"))
    return relational.range_join(points, ranges, "at", "low", "high", 2.0).select("o_orderkey", "p_partkey")


# Streams
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """The events as a stream, counted by hour; each batch is merged into a versioned table."""
    t = dml.VersionedTable(spark, fresh(spark, "stream"))
    schema = load(spark, sf_dir, "events").schema
    t.commit(spark.createDataFrame([], T.StructType().add("start", "timestamp").add("event_type", "string").add("n", "long")), -1)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = windows.tumbling_counts(events, "ts", ["event_type"], "1 hour", "1 hour")
    run = counts.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", fresh(spark, "stream-state"))
    run.foreachBatch(windows.upsert_batches(t, ["start", "event_type"])).start().awaitTermination()
    return t.read().select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


register("incremental_rows", "SELECT max(event_id) AS last, count(*) AS n FROM {events} WHERE ts > (SELECT min(ts) + INTERVAL '1' DAY FROM {events})", "SELECT max(event_id) AS last, count(*) AS n FROM events WHERE ts > (SELECT min(ts) + INTERVAL 1 DAY FROM events)")
