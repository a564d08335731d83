"""Spreadsheet functions over columns and groups, as Column expressions.

Aggregates ignore text and booleans, as a range does; a missing value is empty. Errors are values: functions that can
fail give a struct (x double, err string), so that one bad row doesn't end a job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_away

DIV0, NUM, VALUE = "#DIV/0!", "#NUM!", "#VALUE!"


def _result(x: Column, err: Column) -> Column:
    return F.struct(F.when(err.isNull(), x).alias("x"), err.alias("err"))


def number(text: Column) -> Column:
    """(x, err) of a text in a numeric place: empty is 0, other text that isn't a number is #VALUE!."""
    x = text.try_cast("double")
    return _result(F.when(text.isNull() | (text == ""), 0.0).otherwise(x), F.when(text.isNotNull() & (text != "") & x.isNull(), VALUE))


def divide(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return _result(F.try_divide(a, b), F.when(b == 0, DIV0))


def power(a: Column, b: Column) -> Column:
    x = F.pow(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    return _result(x, F.when(F.isnan(x) | (F.abs(x) == float("inf")), NUM))


def if_error(result: Column, other: Column | float) -> Column:
    return F.when(result.err.isNull(), result.x).otherwise(other)


def if_(test: Column, yes: Column, no: Column | None = None) -> Column:
    """Empty counts as false; without a third argument the result is false."""
    return F.when(F.coalesce(test, F.lit(False)), yes).otherwise(F.lit(False) if no is None else no)


def equal(a: Column, b: Column) -> Column:
    """Texts compare without case; empty equals the empty text."""
    return F.lower(F.coalesce(a, F.lit(""))) == F.lower(F.coalesce(b, F.lit("")))


def sum_(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def average(x: Column) -> Column:
    return _result(F.avg(x), F.when(F.count(x) == 0, DIV0))


def min_(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(0.0))


def max_(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0.0))


def count(x: Column) -> Column:
    return F.count(x)


def counta(v: Column) -> Column:
    return F.count_if(v.isNotNull() & (v != ""))


def round_(x: Column, digits: int = 0) -> Column:
    return half_away(F.coalesce(x, F.lit(0.0)), digits)


def and_(test: Column) -> Column:
    """True for an empty group."""
    return F.coalesce(F.bool_and(test), F.lit(True))


def or_(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def date(year: Column, month: Column, day: Column) -> Column:
    """The serial day; years below 1900 count from 1900, months and days may overflow either way."""
    year = F.when(year < 1900, year + 1900).otherwise(year).cast("int")
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), (month - 1).cast("int"))
    return F.datediff(first, F.lit("1899-12-30").cast("date")) + day.cast("int") - 1


def matches(criterion: str | float, x: Column, v: Column | None = None) -> Column:
    """Whether a cell (number x, or text v where x is null) meets a criterion such as ">=10" or "<>Done". If either
    side is text both compare as lower-case text; otherwise as numbers, empty as 0."""
    op, rest = re.match(r"(<>|<=|>=|=|<|>)?(.*)", str(criterion), re.S).groups()
    try:
        target: float | None = float(rest) if rest.strip() else None
    except ValueError:
        target = None
    compare = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op or "="]
    text = v if v is not None else F.lit(None).cast("string")
    is_text = text.isNotNull() & (text != "") & x.isNull()
    as_text = F.lower(F.coalesce(text, F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(x.cast("string")), F.lit("")))
    by_text = getattr(as_text, compare)(F.lit(rest.lower()))
    if target is None:
        return by_text
    return F.when(is_text, by_text).otherwise(getattr(F.coalesce(x, F.lit(0.0)), compare)(F.lit(target)))


def sumif(criterion: str | float, x: Column, v: Column | None = None, total: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(matches(criterion, x, v), x if total is None else total)), F.lit(0.0))


def countif(criterion: str | float, x: Column, v: Column | None = None) -> Column:
    return F.count_if(matches(criterion, x, v))


def averageif(criterion: str | float, x: Column, v: Column | None = None, total: Column | None = None) -> Column:
    return average(F.when(matches(criterion, x, v), x if total is None else total))
