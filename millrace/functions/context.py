"""Values of the session and the statement, escapes of the call-level interface, and string casts."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def statement_time() -> dict[str, Column]:
    """The statement's date and times: the same for all rows, however long the statement runs."""
    return {"current_date": F.current_date(), "current_timestamp": F.current_timestamp(), "localtimestamp": F.localtimestamp(), "current_time": F.date_format(F.current_timestamp(), "HH:mm:ss")}


def time_of(precision: int = 0) -> Column:
    """CURRENT_TIME(p) as text; only precisions 0 to 3 exist."""
    if not 0 <= precision <= 3:
        raise ValueError("precision is 0 to 3")
    return F.date_format(F.current_timestamp(), "HH:mm:ss" + (f".{'S' * precision}" if precision else ""))


def session_values(spark: SparkSession) -> dict[str, Column]:
    """USER and its relatives, and where names are looked up."""
    user = F.current_user()
    return {"user": user, "current_user": user, "session_user": F.session_user(), "system_user": F.lit(spark.sparkContext.sparkUser()), "current_catalog": F.current_catalog(), "current_schema": F.current_schema(), "current_role": F.lit(None).cast("string"), "current_path": F.lit("")}


#: Names of scalar functions in {fn ...} escapes and the engine's own (fixed values).
ESCAPED = {"UCASE": "upper", "LCASE": "lower", "CURDATE": "current_date", "NOW": "now", "LOG": "ln", "IFNULL": "coalesce", "DATABASE": "current_schema"}


def without_escapes(text: str) -> str:
    """SQL with {fn f(...)}, {d '...'}, {t '...'}, {ts '...'} and {oj ...} replaced by the engine's own spelling.

    {fn LENGTH(s)} does not count trailing blanks; {fn INSERT(s, i, n, r)} and {fn LOCATE(x, s)} keep their order of
    arguments; {fn CONCAT(a, b)} is null if one of them is.
    """
    quoted: list[str] = []
    text = re.sub(r"'(?:[^']|'')*'", lambda m: quoted.append(m[0]) or f"\0{len(quoted) - 1}\0", text)
    for _ in range(text.count("{")):
        text = re.sub(r"\{\s*(\w+)\s+([^{}]*)\}", lambda m: _escape(m[1].lower(), m[2].strip()), text, count=1)
    return re.sub("\0(\\d+)\0", lambda m: quoted[int(m[1])], text)


def _escape(kind: str, body: str) -> str:
    if kind in ("d", "t", "ts"):
        return f"{ {'d': 'DATE', 't': 'TIME', 'ts': 'TIMESTAMP'}[kind] } {body}"
    if kind == "oj":
        return body
    if kind != "fn":
        raise ValueError(f"unknown escape {kind}")
    name, _, rest = body.partition("(")
    args = rest.rstrip()[:-1]
    name = name.strip().upper()
    if name == "INSERT":
        s, i, n, r = _arguments(args)
        return f"overlay({s} PLACING {r} FROM {i} FOR {n})"
    if name == "LENGTH":
        return f"char_length(rtrim({args}))"
    if name == "CURTIME":
        return "date_format(current_timestamp(), 'HH:mm:ss')"
    if name == "TRUNCATE":
        x, n = _arguments(args)
        return f"CASE WHEN {x} < 0 THEN ceil({x}, {n}) ELSE floor({x}, {n}) END"
    return f"{ESCAPED.get(name, name.lower())}({args})"


def _arguments(text: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i].strip())
            last = i + 1
    return [*out, text[last:].strip()]


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    """BETWEEN SYMMETRIC: the bounds in either order; null if one of them decides nothing."""
    return x.between(a, b) | x.between(b, a)


def convert_using(s: Column, charset: str) -> Column:
    """The bytes of a string in a character set."""
    return F.encode(s, charset)


def cast_text(s: Column, kind: str) -> Column:
    """CAST from a string: blanks around go; what is not of the kind, or too large, raises."""
    text = F.trim(s)
    if kind in ("tinyint", "smallint", "int", "bigint"):  # a fraction rounds half away from zero
        return F.round(text.cast("decimal(38,10)"), 0).cast(kind)
    return text.cast(kind)


def cast_char(x: Column, n: int, padded: bool = True) -> Column:
    """CAST to CHAR(n) or VARCHAR(n): cut to n characters, CHAR with blanks up to n."""
    text = F.substring(x.cast("string"), 1, n)
    return F.rpad(text, n, " ") if padded else text


#: How a zone's shift is written (fixed value): a sign, hours, minutes.
ZONE_SHIFT = re.compile(r"([+-]?)(\d{1,2}):?(\d{1,2})?")


def adjust_timestamp(ts: Column, zone: str | None, hours: int = 0) -> Column:
    """The timestamp moved by [+-]hh[:][mm] if the zone's text has that, else by whole hours; a null zone leaves it."""
    if zone is None:
        return ts
    m = ZONE_SHIFT.search(zone)
    minutes = (int(m[2]) * 60 + int(m[3] or 0)) * (-1 if m[1] == "-" else 1) if m else 60 * hours
    return F.timestamp_add("MINUTE", F.lit(minutes), ts)


#: Days from 0001-01-01 to 1970-01-01, which internal dates count from (fixed value).
INTERNAL_EPOCH = 719163


def internal_date(n: Column) -> Column:
    """Text of a time that is given in milliseconds since the year 1; -1 is null."""
    seconds = (n / F.lit(1000)).cast("decimal(20,3)") - F.lit(INTERNAL_EPOCH * 86400)
    text = F.date_format(F.timestamp_seconds(F.floor(seconds)), "EEE MMM dd HH:mm:ss 'UTC' yyyy")
    return F.when(n == -1, F.lit(None).cast("string")).otherwise(text)


def difference(a: Column, b: Column, unit: str) -> Column:
    """(a - b) in whole units: YEAR and MONTH by the calendar, the others by time; fractions go."""
    return F.timestamp_diff(unit.upper(), b, a)
