"""Comparison and arithmetic where a missing value ranks above every number.

SQL comparisons return NULL when an operand is NULL. Panel scripts written for
statistical packages rely on another rule: missing is larger than any number and
equal to missing. These helpers give that rule as plain, never-NULL columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def m_gt(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.coalesce(a > b, a.isNull() & b.isNotNull())


def m_ge(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.coalesce(a >= b, a.isNull())


def m_lt(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.coalesce(a < b, a.isNotNull() & b.isNull())


def m_le(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.coalesce(a <= b, b.isNull())


def m_eq(a, b) -> Column:
    return _c(a).eqNullSafe(_c(b))


def m_ne(a, b) -> Column:
    return ~_c(a).eqNullSafe(_c(b))


def m_div(a, b) -> Column:
    """Quotient, missing when the divisor is zero or missing."""
    return F.try_divide(_c(a), _c(b))


def is_true(cond: Column) -> Column:
    """A condition as a never-NULL boolean: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """A condition as 0/1."""
    return is_true(cond).cast("int")


def sum0(x) -> Column:
    """Sum with missing counted as zero, also over all-missing groups."""
    x = F.col(x) if isinstance(x, str) else x
    s = F.sum(x)
    return F.coalesce(s, F.lit(0))


def firstnm(x) -> Column:
    """First non-missing of a 1/missing flag; the maximum is the same and repeatable."""
    return F.max(F.col(x) if isinstance(x, str) else x)
