"""Delimited files with a control file, header mapping, lenient rows and a reject table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of control files and the types they are read as (fixed values).
BCP_TYPES = {"SQLCHAR": "string", "SQLVARCHAR": "string", "SQLTINYINT": "tinyint", "SQLSMALLINT": "smallint", "SQLINT": "int", "SQLBIGINT": "bigint", "SQLREAL": "float", "SQLFLT4": "float", "SQLFLT8": "double", "SQLDOUBLE": "double", "SQLDECIMAL": "decimal(19,6)", "SQLBIT": "boolean", "SQLDATE": "date", "SQLTIME": "string", "SQLTIMESTAMP": "timestamp_ntz"}


def parse_bcp(text: str) -> T.StructType:
    """Schema of a control file: version, number of columns, then one line for each column."""
    lines = [x for x in text.splitlines() if x.strip()]
    n = int(lines[1])
    out = T.StructType()
    for line in lines[2 : 2 + n]:
        word = re.findall(r'"[^"]*"|\S+', line)
        out.add(word[6].strip('"').lower(), T._parse_datatype_string(BCP_TYPES[word[1].upper()]))
    return out


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, field: str = ",", quote: str = '"', escape: str = '"', header: bool = True, lenient: bool = True, trim: bool = True, mapped: bool = False, date_format: str | None = None, sample_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines). A row with another number of columns is bad unless lenient: then missing fields
    are null and extra ones go. `mapped` takes fields by the header's names. Values that do not fit are bad.

    Without a schema, names come from the header and types from the first `sample_rows` rows, which is all that is
    read for them; a later value that does not fit such a type makes its row bad."""
    text = spark.read.options(sep=field, quote=quote, escape=escape, header=header, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim, mode="PERMISSIVE", enforceSchema=True)
    head = spark.read.text(path).limit(sample_rows + 1).collect()  # so many lines, of which one may be the header
    sample = spark.read.options(sep=field, quote=quote, escape=escape, header=header, inferSchema=True, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim)
    first = sample.csv(spark.sparkContext.parallelize([r[0] for r in head], 1)).schema
    raw_names = [f.name for f in first]
    if schema is None:
        schema = first
    names = [c.lower() for c in raw_names] if mapped else [f.name for f in schema] + [f"__extra{i}" for i in range(max(0, len(raw_names) - len(schema)))]
    strings = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField("__bad", T.StringType())])
    rows = text.schema(strings).options(columnNameOfCorruptRecord="__bad").csv(path)
    cells = []
    for f in schema:
        c = F.col(f.name) if f.name in names else F.lit(None).cast("string")
        cells.append((f, c, F.try_to_timestamp(c, F.lit(date_format)).cast(f.dataType) if date_format and isinstance(f.dataType, (T.DateType, T.TimestampNTZType)) else c.try_cast(f.dataType)))
    wrong = F.lit(False) if lenient else F.col("__bad").isNotNull()
    for _, c, v in cells:
        wrong = wrong | (c.isNotNull() & v.isNull())
    marked = rows.withColumn("__wrong", wrong)
    return marked.where("NOT __wrong").select(*(v.alias(f.name) for f, _, v in cells)), marked.where("__wrong").select(F.coalesce("__bad", F.concat_ws(field, *names)).alias("line"))


def export(df: DataFrame, path: str, field: str = ",", header: bool = True) -> None:
    df.write.options(sep=field, header=header, quoteAll=False).mode("errorifexists").csv(path)


def bcp_of(schema: T.StructType, field: str = ",") -> str:
    """A control file for a schema."""
    back = {v: k for k, v in reversed(BCP_TYPES.items())}
    kind = lambda d: back.get(d.simpleString(), "SQLDECIMAL" if d.simpleString().startswith("decimal") else "SQLVARCHAR")
    lines = [f'{i + 1} {kind(f.dataType)} 0 0 "{field if i + 1 < len(schema) else chr(92) + "n"}" {i + 1} {f.name}' for i, f in enumerate(schema)]
    return "\n".join(["6.0", str(len(schema)), *lines]) + "\n"


def export_with_schema(df: DataFrame, path: str, field: str = ",") -> tuple[str, T.StructType]:
    """Rows to path/data with a header, and their control file to path/control; what read() needs to get them back."""
    export(df, f"{path}/data", field)
    spark = df.sparkSession
    spark.createDataFrame([(bcp_of(df.schema, field),)], "text string").coalesce(1).write.text(f"{path}/control")
    text = "".join(r[0] for r in spark.read.text(f"{path}/control", wholetext=True).collect())  # one small file
    return f"{path}/data", parse_bcp(text)
