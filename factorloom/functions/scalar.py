"""Scalar mathematics of one row: protected forms, which are defined everywhere, and plain ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.functions.core import Value, col

#: Below SMALL a divisor counts as none; LARGE bounds powers and EXPONENT exponents.
SMALL, LARGE, EXPONENT = 1e-3, 1e6, 100.0


def _or(x: Column, condition: Column, otherwise: float) -> Column:
    return F.when(condition, x).otherwise(F.when(condition.isNotNull(), otherwise))


# Protected forms of genetic programs.


def div(a: Value, b: Value) -> Column:
    """1 where the divisor is at most SMALL in size."""
    return _or(F.try_divide(col(a), col(b)), F.abs(col(b)) > SMALL, 1.0)


def sqrt(x: Value) -> Column:
    return F.sqrt(F.abs(col(x)))


def log(x: Value) -> Column:
    """Of the size; 0 where that is at most SMALL."""
    return _or(F.ln(F.abs(col(x))), F.abs(col(x)) > SMALL, 0.0)


def inv(x: Value) -> Column:
    return _or(F.try_divide(F.lit(1.0), col(x)), F.abs(col(x)) > SMALL, 0.0)


def sig(x: Value) -> Column:
    return F.lit(1.0) / (1 + F.exp(-col(x)))


PROTECTED = {
    "add": lambda a, b: col(a) + col(b), "sub": lambda a, b: col(a) - col(b), "mul": lambda a, b: col(a) * col(b), "div": div, "sqrt": sqrt, "log": log, "neg": lambda x: -col(x), "inv": inv,
    "abs": lambda x: F.abs(col(x)), "max": lambda a, b: F.greatest(col(a), col(b)), "min": lambda a, b: F.least(col(a), col(b)), "sin": lambda x: F.sin(col(x)), "cos": lambda x: F.cos(col(x)), "tan": lambda x: F.tan(col(x)), "sig": sig,
}


# Plain forms.


def _power(n: int):
    return lambda x: reduce(lambda a, b: a * b, [col(x)] * n)


def harmonic(x: Value) -> Column:
    """The harmonic number: the sum of 1 / k for whole numbers, else its asymptotic series."""
    x = col(x)
    whole = F.aggregate(F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x.cast("long"))).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda s, k: s + 1 / k)
    series = 0.57721566490153286060651209008240243104215933593992 + F.ln(x) + 0.5 / x - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when((x == F.floor(x)) & (x >= 0) & (x <= 10_000), whole).otherwise(F.when(x > 0, series))


PLAIN = {
    "sin": lambda x: F.sin(col(x)), "cos": lambda x: F.cos(col(x)), "tan": lambda x: F.tan(col(x)), "exp": lambda x: F.exp(col(x)), "log": lambda x: F.ln(col(x)), "sqrt": lambda x: F.sqrt(col(x)), "n2": _power(2), "n3": _power(3), "n4": _power(4),
    "neg": lambda x: -col(x), "abs": lambda x: F.abs(col(x)), "max": lambda a, b: F.greatest(col(a), col(b)), "min": lambda a, b: F.least(col(a), col(b)), "tanh": lambda x: F.tanh(col(x)), "inv": lambda x: F.try_divide(F.lit(1.0), col(x)),
    "logabs": lambda x: F.ln(F.abs(col(x))), "expneg": lambda x: F.exp(-col(x)), "sigmoid": sig, "harmonic": harmonic,
}


def _bounded(n: int):
    """A power where the base is under LARGE in size, else 0."""
    return lambda x: _or(_power(n)(x), F.abs(col(x)) < LARGE, 0.0)


def _guarded_expneg(x: Value) -> Column:
    return _or(F.exp(-col(x)), col(x) > -EXPONENT, 0.0)


#: The plain names with every place defined: 1 for a quotient without divisor, 0 for the rest that is not defined.
GUARDED = {
    "div": div, "exp": lambda x: _or(F.exp(col(x)), col(x) < EXPONENT, 0.0), "log": log, "logabs": log, "sqrt": sqrt, "inv": inv, "expneg": _guarded_expneg,
    "n2": _bounded(2), "n3": _bounded(3), "n4": _bounded(4), "sigmoid": lambda x: F.lit(1.0) / (1 + _guarded_expneg(x)),
}

#: What is laid around a generated formula, and how two are joined.
WRAPS = {"abs": lambda x: F.abs(col(x)), "log": lambda x: F.ln(F.abs(col(x)) + 1e-8), "neg": lambda x: -col(x)}
JOINS = {"add": lambda a, b: col(a) + col(b), "sub": lambda a, b: col(a) - col(b), "mul": lambda a, b: col(a) * col(b), "div": lambda a, b: col(a) / (col(b) + 1e-8)}
