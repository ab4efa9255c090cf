"""Procedures around ETL: tables made from queries, statements for each table of a schema, variables, statistics.

They act on Spark's catalog. Loops go over names of tables or variables, never over rows.
"""

from __future__ import annotations

import contextlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_]\w*")


def quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def create_table_as(df: DataFrame, schema: str, name: str, with_rows: bool = True) -> None:
    """A table with the columns of `df`, and its rows; an existing table raises."""
    (df if with_rows else df.limit(0)).write.saveAsTable(quoted(schema, name), mode="errorifexists")


def create_table_at(df: DataFrame, path: str, with_rows: bool = True) -> None:
    """create_table_as for a folder that stands for the table."""
    (df if with_rows else df.limit(0)).write.mode("errorifexists").parquet(path)


def create_table_like(spark: SparkSession, source: str, schema: str, name: str, more: dict[str, str] | None = None) -> None:
    """An empty table with the columns of `source` and further typed columns."""
    df = spark.table(source).limit(0)
    create_table_as(df.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in (more or {}).items())), schema, name)


def for_entire_schema(spark: SparkSession, schema: str, statement: str) -> list[str]:
    """Run `statement` for each table of the schema, %TABLE_NAME% and %SCHEMA_NAME% replaced; the names it ran for."""
    names = sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)
    for n in names:
        spark.sql(statement.replace("%TABLE_NAME%", quoted(n)).replace("%SCHEMA_NAME%", quoted(schema)))
    return names


def compute_statistics(spark: SparkSession, schema: str) -> list[str]:
    return for_entire_schema(spark, schema, "ANALYZE TABLE %SCHEMA_NAME%.%TABLE_NAME% COMPUTE STATISTICS FOR ALL COLUMNS")


def drop_schema_if_exists(spark: SparkSession, schema: str, cascade: bool = False) -> None:
    spark.sql(f"DROP SCHEMA IF EXISTS {quoted(schema)} {'CASCADE' if cascade else 'RESTRICT'}")


def execute_if_no_rows(spark: SparkSession, check: str, statement: str) -> bool:
    """Run `statement` if the query `check` returns no row; whether it ran."""
    if not spark.sql(check).isEmpty():
        return False
    spark.sql(statement)
    return True


def ddl_of(df: DataFrame, name: str) -> str:
    """CREATE TABLE for the columns of `df`."""
    cols = ",\n".join(f"  {quoted(f.name)} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema)
    return f"CREATE TABLE {quoted(name)} (\n{cols}\n)"


def sql_problem(spark: SparkSession, text: str) -> str | None:
    """What is wrong with a statement, from its analysis alone; None if nothing is."""
    from pyspark.errors import PySparkException

    try:
        said = "\n".join(r[0] for r in spark.sql(f"EXPLAIN {text}").collect())  # the lines of one plan
    except PySparkException as e:
        return str(e).strip().splitlines()[0]
    _, found, why = said.partition("Error occurred during query planning:")
    return why.strip().partition("\n")[0] if found else None


def sql_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str, null_on_null: bool = False) -> None:
    """A function written in SQL, expanded into the plan; with null_on_null, a null argument gives null unread."""
    names = [a.split()[0] for a in arguments.split(",") if a.strip()]
    if null_on_null and names:
        body = f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n in names)} THEN NULL ELSE {body} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def plan_of(df: DataFrame, mode: str = "formatted") -> str:
    """The text of EXPLAIN for a DataFrame."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """ALTER SESSION SET for a block: names with __ for a dot; what they were before comes back at its end."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tagged(spark: SparkSession, tag: str, run):
    """Run a statement under a tag, by which another thread can kill it."""
    spark.sparkContext.addJobTag(tag)
    try:
        return run()
    finally:
        spark.sparkContext.removeJobTag(tag)


def kill(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def create_indexes(df: DataFrame, rid: str, threshold: float) -> dict[str, DataFrame]:
    """Bitmap indexes for the columns of few values, by name."""
    from millrace.operators import bitmaps
    from millrace.operators import table_functions as T

    names = [r[0] for r in T.index_candidates(df.drop(rid), threshold).collect()]  # names of columns
    return {c: bitmaps.build(df, c, rid) for c in names}


class Servers:
    """Foreign servers by name, each with a reader of its objects; a foreign table is read when it is used."""

    def __init__(self):
        self._all: dict[str, object] = {}

    def create(self, name: str, reader) -> None:
        """reader(object name) gives a DataFrame."""
        if name in self._all:
            raise ValueError(f"server {name} exists")
        self._all[name] = reader

    def drop(self, name: str) -> None:
        del self._all[name]

    def table(self, server: str, name: str) -> DataFrame:
        if server not in self._all:
            raise LookupError(f"no server {server}")
        return self._all[server](name)


class Routines:
    """Functions of the user's own by name and types of arguments; the first whose types the arguments have is taken,
    else the first to whose types they can be widened."""

    WIDER = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def __init__(self):
        self._all: dict[str, list[tuple[list[str], object]]] = {}

    def add(self, name: str, kinds: list[str], body) -> None:
        """body: Columns to a Column."""
        if any(k == kinds for k, _ in self._all.get(name, [])):
            raise ValueError(f"{name}({', '.join(kinds)}) exists")
        self._all.setdefault(name, []).append((kinds, body))

    def _fits(self, have: str, want: str) -> bool:
        return have == want or have in self.WIDER and want in self.WIDER and self.WIDER.index(have) <= self.WIDER.index(want)

    def call(self, df: DataFrame, name: str, *columns: str) -> Column:
        have = [df.schema[c].dataType.simpleString() for c in columns]
        known = [(k, b) for k, b in self._all.get(name, []) if len(k) == len(have)]
        for same in (lambda h, w: h == w, self._fits):
            for kinds, body in known:
                if all(map(same, have, kinds)):
                    return body(*(F.col(c).cast(k) for c, k in zip(columns, kinds, strict=True)))
        raise LookupError(f"no {name}({', '.join(have)})")


class Procedures:
    """CALL: procedures by name; each gets the session and its arguments and returns its out parameters."""

    def __init__(self):
        self._all: dict[str, object] = {}

    def add(self, name: str, body) -> None:
        self._all[name.lower()] = body

    def call(self, spark: SparkSession, name: str, *arguments, **named):
        if name.lower() not in self._all:
            raise LookupError(f"no procedure {name}")
        return self._all[name.lower()](spark, *arguments, **named)


def aggregate(parts, result):
    """A user's aggregate: parts(*columns) names the built-in aggregates it needs, result(parts) combines them. As
    these are built-in, each task combines its rows first."""

    def run(df: DataFrame, keys: list[str], *columns: Column, name: str = "value") -> DataFrame:
        cells = df.select(*keys, *(c.alias(f"__{i}") for i, c in enumerate(columns)))
        made = {f"__p_{k}": v for k, v in parts(*(F.col(f"__{i}") for i in range(len(columns)))).items()}
        out = cells.groupBy(*keys).agg(*(v.alias(k) for k, v in made.items()))
        return out.select(*keys, result({k[4:]: F.col(k) for k in made}).alias(name))

    return run


def table_function(body, schema: str):
    """A user's table function: body(frames, **arguments) gets the cursor's rows as pandas frames of bounded size and
    yields frames of `schema`."""

    def run(cursor: DataFrame, **arguments) -> DataFrame:
        return cursor.mapInPandas(lambda frames: body(frames, **arguments), schema)

    return run


class Variables:
    """Application variables by (context, name), text values; unknown names raise, a variable not set is null."""

    def __init__(self):
        self._contexts: dict[str, dict[str, str | None]] = {}

    def create(self, context: str, name: str | None = None) -> None:
        if not NAME.fullmatch(context) or name is not None and not NAME.fullmatch(name):
            raise ValueError("a name is a letter or _, then letters, digits or _")
        variables = self._contexts.setdefault(context, {})
        if name is not None:
            if name in variables:
                raise ValueError(f"{context}.{name} exists")
            variables[name] = None

    def _of(self, context: str, name: str) -> dict[str, str | None]:
        if name not in self._contexts.get(context, {}):
            raise KeyError(f"{context}.{name}")
        return self._contexts[context]

    def set(self, context: str, name: str, value: str | None) -> None:
        self._of(context, name)[name] = value

    def get(self, context: str, name: str) -> Column:
        """The value as a literal, so that filters on it reach the scan."""
        return F.lit(self._of(context, name)[name]).cast("string")

    def delete(self, context: str, name: str | None = None) -> None:
        if name is None:
            del self._contexts[context]
        else:
            del self._of(context, name)[name]
