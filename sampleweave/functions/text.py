"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what separates words, and what reads as a number.
NON_WORD = r"\W+"
NUMBER = r"^[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?)$"


def words(text: Column) -> Column:
    """Lower-cased words, without empty ones."""
    return F.filter(F.split(F.lower(text), NON_WORD), lambda w: w != "")


def first_number(text: Column, separator: str = " ") -> Column:
    """The first part that reads as a number, 0 if there is none."""
    parts = F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    numbers = F.filter(parts, lambda p: p.rlike(NUMBER))
    first = F.regexp_replace(F.get(numbers, F.lit(0)), "(?<=[0-9.])[dDfF]$", "")
    return F.coalesce(first.try_cast("double"), F.lit(0.0))


def without_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"[()]", "")


def factor_line(identity: Column, factors: Column) -> Column:
    """``(id, f1,f2,...)``"""
    return F.concat(F.lit("("), identity.cast("string"), F.lit(", "),
                    F.array_join(factors.cast("array<string>"), ","), F.lit(")"))


def factor_line_id(line: Column) -> Column:
    return F.trim(F.get(F.split(without_brackets(line), ","), F.lit(0))).cast("long")


def factor_line_values(line: Column) -> Column:
    parts = F.split(without_brackets(line), ",")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: F.trim(p).cast("double"))
