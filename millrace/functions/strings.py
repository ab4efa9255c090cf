"""String functions (Column to Column). Null in, null out, unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq_padded(a: Column, b: Column) -> Column:
    """Equality that ignores trailing blanks."""
    return F.rtrim(a) == F.rtrim(b)


def similar_to(x: Column, pattern: str, escape: str | None = None) -> Column:
    """SQL SIMILAR TO, by translating the pattern to a regular expression on the driver."""
    return x.rlike(similar_pattern(pattern, escape))


def similar_pattern(pattern: str, escape: str | None = None) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            i += 1
            out.append(re.escape(pattern[i]))
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "%":
            out.append("(?s:.*)")
        elif c == "_":
            out.append("(?s:.)")
        elif c in "|*+?{}()":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def _not_negative(n: Column, what: str) -> Column:
    return F.when(n < 0, F.raise_error(F.lit(f"22011: {what} with a negative length"))).otherwise(n)


def left_n(s: Column, n: Column) -> Column:
    return F.substring(s, F.lit(1), _not_negative(n, "LEFTN"))


def right_n(s: Column, n: Column) -> Column:
    n = _not_negative(n, "RIGHTN")
    return F.when(n >= F.length(s), s).otherwise(F.substring(s, F.length(s) - n + 1, n))


def repeater(s: Column, n: Column) -> Column:
    return F.call_function("repeat", s, _not_negative(n, "REPEATER").cast("int"))


def char_replace(s: Column, old: str, new: str) -> Column:
    return F.translate(s, old, new)


def str_replace(s: Column, old: Column, new: Column) -> Column:
    """Replace; a null or empty old string leaves the input as it is."""
    return F.when(old.isNull() | (old == ""), s).otherwise(F.replace(s, old, new))


def contains_number(s: Column) -> Column:
    return s.rlike("[0-9]")


def instr(s: Column, sub: Column, start: int = 1, nth: int = 1) -> Column:
    """Place of the nth occurrence from `start`; a negative start searches backward from the end."""
    if start == 0 or nth < 1:
        raise ValueError("22003: start must not be 0, nth must be positive")
    n, m = F.length(s), F.length(sub)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.substring(s, i, m) == sub)
    if start > 0:
        hits = F.filter(at, lambda i: i >= start)
    else:
        hits = F.reverse(F.filter(at, lambda i: i <= n + start + 1))
    found = F.coalesce(F.try_element_at(hits, F.lit(nth)), F.lit(0))
    far = F.when(F.lit(abs(start)) > n, F.raise_error(F.lit("22003: start beyond the string")))
    return F.when(s.isNull() | sub.isNull(), F.lit(None).cast("int")).when((m == 0) | (m > n), F.lit(0)).otherwise(F.coalesce(far.cast("int"), found))


#: Letters of a telephone keypad and their digits (fixed values).
KEYPAD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")


def clean_phone(s: Column, mask: str = "(999) 999-9999", reject: bool = False) -> Column:
    """Digits of a number put into the mask; letters count as keypad digits, a leading 1 keeps its country part.

    What does not have the mask's number of digits stays as it is, or raises with `reject`.
    """
    digits = F.regexp_replace(F.translate(F.upper(s), *KEYPAD), "[^0-9]", "")
    need, parts, k = mask.count("9"), [], 0
    for piece in re.findall(r"9+|[^9]+", mask):
        if piece[0] == "9":
            parts.append(F.substring(digits, k + 1, len(piece)))
            k += len(piece)
        else:
            parts.append(F.lit(piece))
    d = F.substring(digits, 2, 10)
    long = F.concat(F.lit("1-"), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    other = F.raise_error(F.concat(F.lit("22018: not a phone number: "), s)).cast("string") if reject else s
    return F.when(F.length(digits) == need, F.concat(*parts)).when((F.length(digits) == 11) & digits.startswith("1"), long).otherwise(other)


def is_phone(s: Column) -> Column:
    """Whether clean_phone can bring the text into a form: ten digits, or eleven that begin with 1."""
    digits = F.regexp_replace(F.translate(F.upper(s), *KEYPAD), "[^0-9]", "")
    return (F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1"))


def clean_phone_international(s: Column, reject: bool = False) -> Column:
    """`+` and digits, with single blanks between groups; anything else stays, or raises with `reject`."""
    text = F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*(\+|00|011)", "+"), r"[^0-9+]+", " "))
    good = text.rlike(r"^\+ ?[1-9][0-9 ]{6,18}$")
    other = F.raise_error(F.concat(F.lit("22018: not a phone number: "), s)).cast("string") if reject else s
    return F.when(good, F.regexp_replace(text, r"^\+ ", "+")).otherwise(other)
