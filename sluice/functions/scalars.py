"""Arithmetic, comparison, boolean logic and mathematics on columns.

What has no result is NULL: overflow, a zero divisor, an argument out of a function's domain. `operators.routing.split_errors`
routes such rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON64, EPSILON32 = 2.220446049250313e-16, 1.1920929e-07


def col(x: Column | str | int | float | bool) -> Column:
    """A Column as it is, a string as a column's name, anything else as a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# arithmetic


def add(a, b) -> Column:
    return F.try_add(col(a), col(b))


def subtract(a, b) -> Column:
    return F.try_subtract(col(a), col(b))


def multiply(a, b) -> Column:
    return F.try_multiply(col(a), col(b))


def divide(a, b, integer: bool = False) -> Column:
    """Integers divide towards zero; NULL for a zero divisor and for the one quotient that overflows."""
    a, b = col(a), col(b)
    if not integer:
        return F.try_divide(a, b)
    a, b = a.cast("long"), b.cast("long")
    fits = (b != 0) & ~((a == F.lit(-(2**63))) & (b == -1))
    return F.when(fits, (F.try_subtract(a, F.try_mod(a, b)).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long"))


def modulo(a, b) -> Column:
    """Sign of the dividend; NULL for a zero divisor."""
    return F.try_mod(col(a), col(b))


def power(base, exponent, integer: bool = False) -> Column:
    """Integers exactly, by repeated products in 64 bits; NULL for a negative exponent or overflow."""
    base, exponent = col(base), col(exponent)
    if not integer:
        return F.pow(base, exponent)
    base, exponent = base.cast("long"), exponent.cast("long")
    trivial = F.abs(base.cast("decimal(20,0)")) <= 1
    times = F.when(trivial & (exponent > 1), 2 - exponent % 2).otherwise(F.least(exponent, F.lit(64)))
    steps = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    return F.when(exponent >= 0, F.aggregate(steps, F.lit(1).cast("long"), lambda acc, _: F.try_multiply(acc, base)))


# comparison

#: Types that compare with each other by value (fixed values).
NUMBERS = "^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def numbers(a: Column, b: Column) -> Column:
    """Whether both columns hold numbers: known from their types, so the optimiser leaves nothing of it."""
    return F.typeof(a).rlike(NUMBERS) & F.typeof(b).rlike(NUMBERS)


def equal(a, b, floats: str | None = None) -> Column:
    """floats: "float" or "double" compares within the type's epsilon, absolutely. Numbers don't equal what isn't one."""
    a, b = col(a), col(b)
    return F.when(numbers(a, b) | (F.typeof(a) == F.typeof(b)), a == b).otherwise(F.lit(False)) if floats is None else F.abs(a - b) < (EPSILON32 if floats == "float" else EPSILON64)


def not_equal(a, b, floats: str | None = None) -> Column:
    return ~equal(a, b, floats)


def ordered(a: Column, b: Column, test) -> Column:
    """Only numbers have an order: false for all else, whatever it holds."""
    return F.when(numbers(a, b), test(a, b)).otherwise(F.lit(False))


def greater_than(a, b) -> Column:
    return ordered(col(a), col(b), lambda x, y: x > y)


def greater_than_or_equal(a, b) -> Column:
    return ordered(col(a), col(b), lambda x, y: x >= y)


def less_than(a, b) -> Column:
    return ordered(col(a), col(b), lambda x, y: x < y)


def less_than_or_equal(a, b) -> Column:
    return ordered(col(a), col(b), lambda x, y: x <= y)


# boolean logic


def truth(x, kind: str = "boolean") -> Column:
    """kind: the column's type: numbers are true unless zero, strings unless empty."""
    x = col(x)
    if kind == "boolean":
        return x
    return x != "" if kind == "string" else x != 0


def both(a, b) -> Column:
    return col(a) & col(b)


def either(a, b) -> Column:
    return col(a) | col(b)


def negated(a) -> Column:
    return ~col(a)


def exclusive(a, b) -> Column:
    return col(a) != col(b)


def not_both(a, b) -> Column:
    return ~both(a, b)


def neither(a, b) -> Column:
    return ~either(a, b)


# mathematics


def absolute(x) -> Column:
    """NULL for the least integer, which has no absolute value in its type."""
    x = col(x)
    return F.when(x < 0, F.try_subtract(F.lit(0).cast("tinyint"), x)).otherwise(x)


def saturated(x: Column) -> Column:
    """A float as a long, at the type's ends beyond them; NaN as 0."""
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(0)).when(x >= float(2**63), F.lit(2**63 - 1)).when(x <= float(-(2**63)), F.lit(-(2**63))).otherwise(x.cast("long"))


def ceil(x) -> Column:
    x = col(x).cast("double")
    return F.when(F.abs(x) < 2.0**62, F.ceil(x)).otherwise(saturated(x))


def floor(x) -> Column:
    x = col(x).cast("double")
    return F.when(F.abs(x) < 2.0**62, F.floor(x)).otherwise(saturated(x))


def rounded(x) -> Column:
    """Half away from zero."""
    x = col(x).cast("double")
    return saturated(F.when(F.abs(x) < 2.0**52, F.round(x)).otherwise(x))


def exp(x) -> Column:
    return F.exp(col(x))


def log(x, base) -> Column:
    x, base = col(x).cast("double"), col(base).cast("double")
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def sqrt(x) -> Column:
    x = col(x)
    return F.when(x >= 0, F.sqrt(x))


def larger(a, b, floats: bool = False) -> Column:
    """The larger one; of floats, a NaN gives way to the other."""
    a, b = col(a), col(b)
    return F.greatest(F.nanvl(a, b), F.nanvl(b, a)) if floats else F.greatest(a, b)


def smaller(a, b, floats: bool = False) -> Column:
    a, b = col(a), col(b)
    return F.least(F.nanvl(a, b), F.nanvl(b, a)) if floats else F.least(a, b)
