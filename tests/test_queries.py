"""Every query beside its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from millrace.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events pages".split()


def text(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_one_map_side_combine(spark, sf_dir):
    plan = QUERIES["tpch_q1"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan
