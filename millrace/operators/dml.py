"""Insert, update, delete and merge on versioned Parquet, with labels.

A version of a table is a list of immutable files and a schema, kept in the log. Appending adds files; delete, update
and merge rewrite only the files that hold a row they change. A writer reads one version and can commit only the
next one: if another writer has committed meanwhile, `Conflict` is raised and nothing is lost; inserts, which
depend on no row, are tried again on the newer version. Readers see the newest version in the log, or the one
that a label names.

A log entry is written whole under another name and then renamed to its own, which fails if that exists. This is
atomic on HDFS and, but for a moment between two checks, on local disks. A store whose rename copies
(plain object stores) needs a lock around `commit`. All operations go through Hadoop's FileSystem.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.table_functions import Sequence


class Conflict(RuntimeError):
    """Another writer has committed a version after the one that was read."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm

    # Files of the table's folder
    def _fs(self, p: str):
        path = self._jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith((".", "_"))) if fs.exists(p) else []

    def _put(self, name: str, text: str) -> None:
        """A file that appears whole or not at all, and never in the place of another."""
        folder, _, last = f"{self.path}/{name}".rpartition("/")
        fs, part = self._fs(f"{folder}/_{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._jvm.org.apache.hadoop.fs.Path(f"{folder}/{last}")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(part).toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            files.rename(fs.makeQualified(part), fs.makeQualified(target), options)
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{name} is there") from None
            raise

    def _get(self, name: str) -> str:
        fs, p = self._fs(f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # Versions
    @property
    def version(self) -> int:
        return max((int(n) for n in self._names("log")), default=-1)

    def _entry(self, v: int) -> dict:
        if v < 0:
            raise ValueError("the table has no version yet")
        return json.loads(self._get(f"log/{v:012d}"))

    def _rows(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in files))

    def read(self, label: str | None = None, version: int | None = None) -> DataFrame:
        v = int(self._get(f"labels/{label}")) if label else self.version if version is None else version
        entry = self._entry(v)
        return self._rows(entry["files"], T.StructType.fromJson(entry["schema"]))

    def _write(self, df: DataFrame) -> list[str]:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        return [f"{name}/{f}" for f in self._names(f"data/{name}")]

    def _log(self, base: int, files: list[str], schema: T.StructType) -> int:
        self._put(f"log/{base + 1:012d}", json.dumps({"files": files, "schema": schema.jsonValue()}))
        return base + 1

    def commit(self, df: DataFrame, base: int | None = None) -> int:
        """Write df as the whole next version after `base` (by default the newest now)."""
        base = self.version if base is None else base
        return self._log(base, self._write(df), df.schema)

    def _hit(self, base: int, names: DataFrame) -> tuple[list[str], list[str], T.StructType]:
        """(other files, files that are named, schema). Names of files come to the driver, as those in the log do."""
        entry = self._entry(base)
        ends = {r[0] for r in names.select(F.regexp_extract("file", r"/data/([^/]+/[^/]+)$", 1)).distinct().collect()}
        return [f for f in entry["files"] if f not in ends], [f for f in entry["files"] if f in ends], T.StructType.fromJson(entry["schema"])

    def _rewritten(self, base: int, names: DataFrame, change, more: DataFrame | None = None) -> int:
        rest, files, schema = self._hit(base, names)
        new = self._write(change(self._rows(files, schema))) if files else []
        return self._log(base, rest + new + (self._write(more) if more is not None else []), schema)

    # Statements. `base` is the version that the statement reads, by default the newest now.
    def insert(self, rows: DataFrame, tries: int = 20) -> int:
        base = self.version
        schema = T.StructType.fromJson(self._entry(base)["schema"])
        new = self._write(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema)))
        for _ in range(tries):
            try:
                return self._log(base, self._entry(base)["files"] + new, T.StructType.fromJson(self._entry(base)["schema"]))
            except Conflict:
                base = self.version
        raise Conflict("too many other writers")

    def delete(self, cond: Column, base: int | None = None) -> int:
        base = self.version if base is None else base
        return self._rewritten(base, self.read(version=base).where(cond).select(F.input_file_name().alias("file")), lambda t: deleted(t, cond))

    def update(self, cond: Column, new: dict[str, Column], base: int | None = None) -> int:
        base = self.version if base is None else base
        return self._rewritten(base, self.read(version=base).where(cond).select(F.input_file_name().alias("file")), lambda t: updated(t, cond, new))

    def merge(self, source: DataFrame, on: list[str], update: list[str] | dict[str, Column] | None = None, insert: bool | dict[str, Column] = True, base: int | None = None) -> int:
        base = self.version if base is None else base
        target = self.read(version=base)
        matched = target.select(*on, F.input_file_name().alias("file")).join(source.select(*on), on, "left_semi").select("file")
        more = merge_inserts(target, source, on, insert) if insert else None
        return self._rewritten(base, matched, lambda t: merge_updates(t, source, on, update), more)

    def truncate(self, base: int | None = None) -> int:
        base = self.version if base is None else base
        return self._log(base, [], T.StructType.fromJson(self._entry(base)["schema"]))

    def rebuild(self, files: int, base: int | None = None) -> int:
        """The same rows in so many files."""
        base = self.version if base is None else base
        return self.commit(self.read(version=base).repartition(files), base)

    def add_column(self, name: str, default: Column, base: int | None = None) -> int:
        base = self.version if base is None else base
        return self.commit(self.read(version=base).withColumn(name, default), base)

    # Labels
    def label(self, name: str, version: int | None = None) -> None:
        self._put(f"labels/{name}", str(self.version if version is None else version))

    def drop_label(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/labels/{name}")
        fs.delete(p, False)

    def restore(self, label: str) -> int:
        """ROLLBACK to a savepoint: the rows of the labelled version are the newest again. No file is written."""
        old = self._entry(int(self._get(f"labels/{label}")))
        return self._log(self.version, old["files"], T.StructType.fromJson(old["schema"]))

    def backup(self, path: str, label: str | None = None) -> VersionedTable:
        """A copy of the newest version, or of a labelled one, as a table of its own."""
        copy = VersionedTable(self.spark, path)
        copy.commit(self.read(label=label), -1)
        return copy

    def vacuum(self) -> int:
        """Delete versions that are neither the newest nor labelled, and files that no version has; returns how many versions."""
        keep = {self.version} | {int(self._get(f"labels/{n}")) for n in self._names("labels")}
        used = {f for v in keep for f in self._entry(v)["files"]}
        gone = [int(n) for n in self._names("log") if int(n) not in keep]
        old = {f for v in gone for f in self._entry(v)["files"]} - used
        for p in [*(f"log/{v:012d}" for v in gone), *(f"data/{f}" for f in old)]:
            fs, path = self._fs(f"{self.path}/{p}")
            fs.delete(path, True)
        return len(gone)


class DefinedTable(VersionedTable):
    """A table with column defaults, columns that must not be null, a primary key and an identity column."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, defaults: dict[str, Column] | None = None, not_null: tuple[str, ...] = (), key: tuple[str, ...] = (), identity: tuple[str, Sequence, list[str]] | None = None):
        """identity: the column, its sequence, and the columns whose order gives the numbers."""
        super().__init__(spark, path)
        self.schema, self.defaults, self.not_null, self.key, self.identity = schema, defaults or {}, not_null, key, identity
        if self.version < 0:
            self._log(-1, [], schema)

    def insert(self, rows: DataFrame, tries: int = 20) -> int:
        if self.identity and self.identity[0] not in rows.columns:
            column, sequence, order = self.identity
            rows = sequence.assign(rows, order, column)
        rows = conformed(rows, self.schema, self.defaults)
        for c in self.not_null:
            rows = rows.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"23502: {c} is null")).cast(self.schema[c].dataType)))
        if not self.key:
            return super().insert(rows, tries)
        base = self.version  # a key is unique in the version that was read, so another writer's rows are a conflict
        new = self._write(unique_rows(self.read(version=base), rows, list(self.key)))
        return self._log(base, self._entry(base)["files"] + new, self.schema)


def deleted(target: DataFrame, cond: Column) -> DataFrame:
    """The rows for which the condition is not true."""
    return target.where(~F.coalesce(cond, F.lit(False)))


def updated(target: DataFrame, cond: Column, new: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    return target.select(*(F.when(hit, new[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in new else F.col(c) for c in target.columns))


def merge_updates(target: DataFrame, source: DataFrame, on: list[str], update: list[str] | dict[str, Column] | None = None) -> DataFrame:
    """The target's rows after WHEN MATCHED: `update` names columns to take over, or gives expressions over the
    target's columns (t.x) and the source's (s.x). A target row that several source rows match raises."""
    if update is None:
        update = [c for c in source.columns if c not in on]
    new = update if isinstance(update, dict) else {c: F.col(f"s.{c}") for c in update}
    if not new:
        return target
    row = F.struct(*(F.col(f"`{c}`") for c in source.columns))
    keyed = source.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.first(row).alias("s"))
    keyed = keyed.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(on)), "n", "s")
    t = target.select(F.struct(*(F.col(f"`{c}`") for c in target.columns)).alias("t"))
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & (F.col(f"t.{c}") == F.col(f"k{i}"))
    both = t.join(keyed, cond, "left")
    once = F.when(F.col("n") > 1, F.raise_error(F.lit("21000: several source rows match a target row")).cast("boolean")).otherwise(F.col("n").isNotNull())
    return both.select(*(F.when(once, new[c]).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in new else F.col(f"t.{c}").alias(c) for c in target.columns))


def merge_inserts(target: DataFrame, source: DataFrame, on: list[str], insert: bool | dict[str, Column] = True) -> DataFrame:
    """The rows of WHEN NOT MATCHED: every source row without a match, so all whose key is null or is there twice
    but not in the target. `insert` gives expressions over s.x; columns without one take the source's, or null."""
    rows = source.join(target.select(*on), on, "left_anti").select(F.struct(*(F.col(f"`{c}`") for c in source.columns)).alias("s"))
    given = insert if isinstance(insert, dict) else {c: F.col(f"s.{c}") for c in source.columns}
    return rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema))


def merged(target: DataFrame, source: DataFrame, on: list[str], update: list[str] | dict[str, Column] | None = None, insert: bool | dict[str, Column] = True) -> DataFrame:
    """The target after a merge."""
    out = merge_updates(target, source, on, update)
    return out.unionByName(merge_inserts(target, source, on, insert)) if insert else out


def conformed(rows: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows with the columns of a table: a column that the rows lack has its default, or null."""
    defaults = defaults or {}
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema))


def with_error_log(rows: DataFrame, rules: dict[str, Column], error_max: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, log): a row that breaks a rule goes to the log with the rules' names. More than `error_max` raise.

    A rule is a condition that must be true; false and null break it. Rows are counted only if there is a limit.
    """
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    marked = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), broken.alias("errors"))
    log = marked.where(F.size("errors") > 0)
    if error_max is not None and log.limit(error_max + 1).count() > error_max:
        raise ValueError(f"more than {error_max} rows have errors")
    return marked.where(F.size("errors") == 0).select("row.*"), log


def unique_rows(target: DataFrame | None, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows, checked for a primary key: a null in it, a key that is there twice or is in the target raises."""
    every = rows.select(*key, F.lit(1).alias("n"))
    if target is not None:
        every = every.unionByName(target.join(rows.select(*key).distinct(), key, "left_semi").select(*key, F.lit(1).alias("n")))
    counts = every.groupBy(*key).agg(F.sum("n").alias("n"))
    fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    once = counts.select(*key, (F.col("n") <= 1).alias("once"))
    both = rows.join(once, key, "left")  # a null finds no count
    ok = F.when(null, fail("23502: null in a key")).when(~F.col("once"), fail("23505: a key is there twice")).otherwise(F.lit(True))
    return both.where(ok).select(*rows.columns)
