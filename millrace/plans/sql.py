"""SQL texts that run on Spark and on DuckDB: {name} stands for a table of the data folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.registry import ORACLE_SQL, QUERIES


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose Spark SQL is `text`; DuckDB runs `oracle`, or the same text.

    The tables' timestamps have no zone, and so have literals here: a comparison casts no column and reaches the scan.
    """
    tables = sorted(set(re.findall(r"\{(\w+)\}", text)))
    plain = re.sub(r"\bTIMESTAMP '", "TIMESTAMP_NTZ '", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(plain, **{t: load(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    if name in QUERIES:
        raise ValueError(f"two queries are called {name}")
    QUERIES[name] = run
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)
