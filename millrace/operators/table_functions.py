"""Table functions for ETL, on DataFrames. Order is given by columns, never by arrival.

Windows are partitioned by the caller's keys. Where there are none, ranks are global by need of the function,
and are made from counts by range-partitioned task instead of one window over all rows (see numbered()).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of this machine only where the engine runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = "file://" + tempfile.mkdtemp(prefix=f"millrace-{os.getpid()}-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder: its rows are computed once."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 in the given order, without a window over all rows.

    The rows are dealt by range and sorted; a row carries its partition and its place there. Counts of partitions, a
    row for each, give the offset of the next. Nothing depends on two runs of the sort being alike: places and
    counts come from one written table.
    """
    rows = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = written(rows.withColumns({"__task": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at"))
    counts = rows.groupBy("__task").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return rows.join(before, "__task").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__task", "__place", "__before")


class Sequence:
    """NEXT VALUE FOR: values start, start + step, ... within low and high; past an end a cycle begins again at the
    other, and without one it raises. The rows of a statement get theirs in the order of columns."""

    def __init__(self, start: int = 1, step: int = 1, low: int | None = None, high: int | None = None, cycle: bool = False):
        if not step:
            raise ValueError("step must not be 0")
        self.low = (start if step > 0 else -(1 << 63)) if low is None else low
        self.high = ((1 << 63) - 1 if step > 0 else start) if high is None else high
        self.start, self.step, self.cycle, self.used = start, step, cycle, 0

    def assign(self, df: DataFrame, order: list[str], name: str) -> DataFrame:
        rows = written(numbered(df, order, "__n"))
        n = F.col("__n") - 1 + self.used
        first = (self.high - self.start if self.step > 0 else self.start - self.low) // abs(self.step) + 1  # values before the first end
        begin = self.low if self.step > 0 else self.high
        again = (self.high - self.low) // abs(self.step) + 1
        plain = F.lit(self.start) + n * self.step
        if self.cycle:
            value = F.when(n < first, plain).otherwise(F.lit(begin) + F.pmod(n - first, F.lit(again)) * self.step)
        else:
            value = F.when(n < first, plain).otherwise(F.raise_error(F.lit("2200H: the sequence is at its end")).cast("long"))
        self.used += rows.count()
        return rows.withColumn(name, value).drop("__n")


def top_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in order; none for n <= 0."""
    return df.orderBy(*order).limit(max(n, 0))


def collapse_rows(df: DataFrame, parent: str, child: str, order: list[str], delimiter: str, most: int = 16384) -> DataFrame:
    """(parent_value, concatenated_child_values, collapsed_row_count); null children are skipped, a text longer
    than `most` characters raises."""
    rows = F.sort_array(F.collect_list(F.when(F.col(child).isNotNull(), F.struct(*order, F.col(child).cast("string").alias("__c")))))
    text = F.array_join(F.transform(rows, lambda r: r["__c"]), delimiter)
    out = df.groupBy(F.col(parent).alias("parent_value")).agg(text.alias("t"), F.count(child).alias("collapsed_row_count"))
    fits = F.when(F.length("t") > most, F.raise_error(F.lit(f"22001: more than {most} characters"))).otherwise(F.col("t"))
    return out.select("parent_value", F.when(F.col("collapsed_row_count") > 0, fits).alias("concatenated_child_values"), "collapsed_row_count")


def collapse_runs(df: DataFrame, parent: str, child: str, order: list[str], delimiter: str, most: int = 16384) -> DataFrame:
    """collapse_rows for rows in the given order: a parent that comes back later begins a new row. (start, ...), with
    start the place of the run's first row."""
    rows = numbered(df, order, "__n")
    keyed = rows.withColumn("__run", F.col("__n") - F.row_number().over(Window.partitionBy(parent).orderBy("__n")))
    tagged = keyed.withColumn("__p", F.struct(F.col(parent).alias("p"), F.col("__run").alias("r")))
    out = collapse_rows(tagged, "__p", child, ["__n"], delimiter, most)
    first = tagged.groupBy("__p").agg(F.min("__n").alias("start")).withColumnRenamed("__p", "parent_value")
    return out.join(first, out["parent_value"].eqNullSafe(first["parent_value"])).select("start", out["parent_value"]["p"].alias("parent_value"), "concatenated_child_values", "collapsed_row_count")


def generate_sequence(df: DataFrame, partition: list[str], order: list[str], start: int | None = 1, step: int | None = 1, name: str = "seq") -> DataFrame:
    """Number the rows of each partition; null start or step is 1, step 0 raises."""
    start, step = 1 if start is None else start, 1 if step is None else step
    if step == 0:
        raise ValueError("step must not be 0")
    if not partition:
        return numbered(df, order, "__n").withColumn(name, F.lit(start) + F.lit(step) * (F.col("__n") - 1)).drop("__n")
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, F.lit(start).cast("long") + F.lit(step) * (F.row_number().over(w) - 1))


def pivot_columns_to_rows(df: DataFrame) -> DataFrame:
    """(param_name, param_value) for each column of a one-row input; any other number of rows raises."""
    if len(df.take(2)) != 1:
        raise ValueError("exactly one row is needed")
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("param_name"), F.col(c).cast("string").alias("param_value")) for c in df.columns))))


def flatten_hierarchy(edges: DataFrame, parent: str, child: str, depth: int = 15, all_levels: bool = False, most: int = 1000) -> DataFrame:
    """Paths from roots to leaves: (vertex_count, multiple_paths, [non_leaf], level1 .. level{depth}).

    Paths grow by one join for each level, past `depth` to give the true count; each level is written once and read
    by the next. The columns after a path's end repeat its last vertex. A cycle raises.
    """
    e = edges.select(F.col(parent).cast("string").alias("p"), F.col(child).cast("string").alias("c")).where("c IS NOT NULL").distinct()
    inner = e.where("p IS NOT NULL")
    roots = e.where("p IS NULL").select("c").union(inner.select("p").join(inner.select(F.col("c").alias("p")), "p", "left_anti")).distinct()
    paths = roots.select(F.array("c").alias("path"), F.col("c").alias("last"))
    levels = []
    for _ in range(most):
        levels.append(paths)
        nxt = written(paths.join(inner, F.col("last") == F.col("p")).select(F.array_append("path", F.col("c")).alias("path"), F.col("c").alias("last"), F.array_contains("path", F.col("c")).alias("again")))
        if not nxt.where("again").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        paths = nxt.drop("again")
        if paths.isEmpty():
            break
    else:
        raise ValueError("the hierarchy is too deep")
    every = reduce(DataFrame.unionByName, levels)
    leaf = ~F.col("has")
    every = every.join(inner.select(F.col("p").alias("last")).distinct().withColumn("has", F.lit(True)), "last", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    if not all_levels:
        every = every.where(leaf)
    n = every.groupBy("last").agg(F.count(F.lit(1)).alias("n"))
    every = every.join(n, "last")
    cols = [F.coalesce(F.try_element_at("path", F.lit(i + 1)), F.col("last") if i < depth else F.lit(None)).alias(f"level{i + 1}") for i in range(depth)]
    flag = [F.col("has").alias("non_leaf")] if all_levels else []
    return every.select(F.size("path").alias("vertex_count"), (F.col("n") > 1).alias("multiple_paths"), *flag, *cols)


def contiguous_intervals(df: DataFrame, partition: list[str], ts: str, clump: str) -> DataFrame:
    """One row for each run of equal clump values: from, until, and what stands before and after it."""
    w = Window.partitionBy(*partition).orderBy(ts)
    at = F.when(F.col(ts).isNull(), F.raise_error(F.lit("null timestamp"))).otherwise(F.col(ts))
    rows = df.select(*partition, at.alias(ts), clump)
    new = F.row_number().over(w) == 1
    rows = rows.withColumn("__new", new | ~F.lag(clump).over(w).eqNullSafe(F.col(clump))).where("__new").drop("__new")
    return rows.select(*partition, F.col(ts).alias("from_timestamp"), clump, F.lead(ts).over(w).alias("until_timestamp"), F.lag(clump).over(w).alias("previous_clump"), F.lag(ts).over(w).alias("previous_from"), F.lead(clump).over(w).alias("next_clump"), F.lead(ts, 2).over(w).alias("next_until"))


def penultimate_values(df: DataFrame, group: list[str], ts: str, designated: str, others: list[str]) -> DataFrame:
    """One row for each group: every value before its own last change, null if it never changed.

    The timestamp is where the designated column's penultimate value began, until is where its last one did.
    """
    w = Window.partitionBy(*group).orderBy(ts)
    first = F.row_number().over(w) == 1
    changed = lambda c: ~first & ~F.lag(c).over(w).eqNullSafe(F.col(c))
    cols = [designated, *others]
    flags = df.select(*group, ts, *cols, *(changed(c).alias(f"__x_{c}") for c in cols), *(F.lag(c).over(w).alias(f"__l_{c}") for c in cols))
    starts = F.array_sort(F.collect_list(F.when(F.col(f"__x_{designated}"), F.col(ts))))
    last = lambda c: F.max_by(F.struct(F.col(f"__l_{c}").alias("v")), F.when(F.col(f"__x_{c}"), F.col(ts)))["v"]
    out = flags.groupBy(*group).agg(F.min(ts).alias("__first"), starts.alias("__s"), *(last(c).alias(c) for c in cols))
    n = F.size("__s")
    return out.select(*group, F.when(n > 1, F.try_element_at("__s", n - 1)).otherwise(F.col("__first")).alias(ts), *cols, F.coalesce(F.when(n > 0, F.try_element_at("__s", n)), F.col("__first")).alias("until_timestamp"))


def effective_to(df: DataFrame, key: list[str], ts: str, seconds: float, name: str = "effective_to_timestamp") -> DataFrame:
    """The next row's timestamp of the same key less a time, null for the last."""
    w = Window.partitionBy(*key).orderBy(ts)
    return df.withColumn(name, F.lead(ts).over(w) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def split_rows(df: DataFrame, column: str, separator: str | None, escape: str | None, trim: bool = False, number: str | None = None) -> DataFrame:
    """One row for each token of a column. An escaped separator belongs to its token, empty tokens go, and a
    row without tokens stays once with null. A null separator or escape gives no rows. `number` names a column
    that counts a row's tokens from 1."""
    if separator is None or escape is None:
        return df.limit(0)
    if len(separator) != 1 or len(escape) != 1:
        raise ValueError("separator and escape are single characters")
    marks = ("", "")
    s = F.replace(F.col(column), F.lit(escape * 2), F.lit(marks[1]))
    s = F.replace(s, F.lit(escape + separator), F.lit(marks[0]))
    tokens = F.transform(F.split(s, "\\Q" + separator + "\\E"), lambda t: F.translate(F.trim(t) if trim else t, "".join(marks), separator + escape))
    tokens = F.filter(tokens, lambda t: t != "")
    if number is None:
        return df.select(*(F.explode_outer(tokens).alias(c) if c == column else F.col(c) for c in df.columns))
    out = df.select(*(F.col(c) for c in df.columns if c != column), F.posexplode_outer(tokens).alias("__at", column))
    return out.select(*df.columns, (F.col("__at") + 1).alias(number))


#: What a null counts as in a checksum of a row (fixed value of this library).
NULL_TEXT = "␀null␀"


def generate_crc(df: DataFrame, columns: list[str] | None = None, exclude: bool = False, name: str = "crc_value") -> DataFrame:
    """CRC-32 over the row's values as text, of the named columns, or of all but these."""
    use = [c for c in df.columns if columns is None or (c in columns) != exclude]
    return df.withColumn(name, F.crc32(F.encode(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)) for c in use)), "UTF-8")))


def enforce_constraints(df: DataFrame, codes: list[str], severity: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by columns of error codes: null and warnings pass, an unknown code is a warning, a fatal one raises."""
    of = lambda level: reduce(lambda a, b: a | b, (F.coalesce(F.col(c).isin([k for k, v in severity.items() if v == level] or [""]), F.lit(False)) for c in codes))
    checked = df.withColumn("__fatal", F.when(of("fatal"), F.raise_error(F.lit("fatal row constraint"))).otherwise(F.lit(False))).where("NOT __fatal").drop("__fatal")
    return checked.where(~of("reject")), checked.where(of("reject"))


def index_candidates(df: DataFrame, threshold: float) -> DataFrame:
    """(column_name, distinct_count) of the columns with 100 * distinct / rows <= threshold, counted exactly.

    Values are counted by (column, value), combined map-side, so a column of many values is spread like any key.
    """
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns))))
    by_value = cells.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("m"))
    rows = by_value.groupBy("column_name").agg(F.count("v").alias("distinct_count"), F.sum("m").alias("__n"))
    return rows.where(100 * F.col("distinct_count") <= threshold * F.col("__n")).select("column_name", "distinct_count")


def time_dimension(spark, start: str, end: str, first_month: int = 1) -> DataFrame:
    """One row for each day, with calendar and fiscal columns; weeks begin on Sunday."""
    from millrace.functions import datetimes as D

    d = F.col("d")
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d"))
    week = F.date_sub(d, F.dayofweek(d) - 1)
    quarter = F.date_trunc("quarter", d).cast("date")
    return days.select(
        d.alias("time_key"), D.julian_day(d).alias("time_key_seq"), F.date_format(d, "EEEE").alias("day_of_week"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), F.dayofweek(d).alias("day_number_in_week"), F.dayofmonth(d).alias("day_number_in_month"), F.dayofyear(d).alias("day_number_in_year"), D.day_number_overall(d).alias("day_number_overall"),
        week.alias("week_start"), F.date_add(week, 6).alias("week_end"), F.date_format(d, "MMMM").alias("month_name"), F.month(d).alias("month_number"), F.trunc(d, "month").alias("month_start"), F.last_day(d).alias("month_end"), F.quarter(d).alias("quarter"), quarter.alias("quarter_start"), F.date_sub(F.add_months(quarter, 3), 1).alias("quarter_end"),
        F.year(d).alias("year"), D.calendar_quarter(d).alias("calendar_quarter"), D.fiscal_month(d, first_month).alias("fiscal_month"), D.fiscal_quarter(d, first_month).alias("fiscal_quarter"), D.fiscal_year(d, first_month).alias("fiscal_year"),
    )


def fiscal_time_dimension(spark, start: str, end: str, first_month: int) -> DataFrame:
    """time_dimension with the starts, ends and places of fiscal quarters and years, which begin in `first_month`."""
    from millrace.functions import datetimes as D

    d = F.col("time_key")
    days = time_dimension(spark, start, end, first_month)
    year_start = F.make_date(F.year(d) - F.when(F.month(d) < first_month, 1).otherwise(0), F.lit(first_month), F.lit(1))
    quarter = F.floor((D.fiscal_month(d, first_month) - 1) / 3)
    quarter_start = F.add_months(year_start, (quarter * 3).cast("int"))
    return days.select(
        "*", (quarter + 1).cast("int").alias("fiscal_quarter_number"), quarter_start.alias("fiscal_quarter_start"), F.date_sub(F.add_months(quarter_start, 3), 1).alias("fiscal_quarter_end"),
        year_start.alias("fiscal_year_start"), F.date_sub(F.add_months(year_start, 12), 1).alias("fiscal_year_end"), (F.date_diff(d, year_start) + 1).alias("day_in_fiscal_year"), (F.date_diff(d, quarter_start) + 1).alias("day_in_fiscal_quarter"), (F.floor(F.date_diff(d, year_start) / 7) + 1).cast("int").alias("week_in_fiscal_year"),
    )
