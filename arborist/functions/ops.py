"""The instruction set of expression trees: one row per opcode, with all its readings.

A value as a numpy function and as a Spark column with IEEE semantics (1/0 is inf, log 0 is -inf,
comparisons with NaN are false), the local derivatives, and a weight for cost models. LOOSE_*
opcodes read as the scoring oracle has them: log|a|, sqrt|a|, |l|^r, plain division and inverse.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

VAR, CONST, UNARY, BINARY, TERNARY = range(5)
NAN, INF = float("nan"), float("inf")


@dataclass(frozen=True)
class Op:
    code: int
    name: str
    arity: int
    array: Callable
    column: Callable
    partials: Callable | None  # (math, operands..., value) -> a derivative for each operand
    cost: int


def divide(left: Column, right: Column) -> Column:
    return F.when(right == 0, left * F.pow(right, F.lit(-1.0))).otherwise(left / right)


def power(left: Column, right: Column) -> Column:
    """pow, with 1 for a base of 1 and for -1 to an infinite power, where the JVM's has NaN."""
    return F.when((left == 1) | ((left == -1) & (F.abs(right) == INF)), F.lit(1.0)).otherwise(F.pow(left, right))


def log(a: Column) -> Column:
    return F.when(a > 0, F.ln(a)).when(a == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def least(left: Column, right: Column) -> Column:
    return F.when(F.isnan(left) | F.isnan(right), F.lit(NAN)).otherwise(F.least(left, right))


def _compared(test: Callable) -> tuple[Callable, Callable]:
    def column(left: Column, right: Column) -> Column:
        return F.when(~F.isnan(left) & ~F.isnan(right) & test(left, right), F.lit(1.0)).otherwise(F.lit(0.0))

    return (lambda left, right: test(left, right).astype(float)), column


class Arrays:
    """What derivatives need of a number system, over numpy arrays."""

    divide, power, log, cos, sin, sinh, cosh, sign = np.divide, np.power, np.log, np.cos, np.sin, np.sinh, np.cosh, np.sign

    @staticmethod
    def at_least(x, y):
        return (x >= y).astype(float)


class Columns:
    """The same over Spark columns."""

    divide, power, log, cos, sin, sinh, cosh, sign = divide, power, log, F.cos, F.sin, F.sinh, F.cosh, F.signum

    @staticmethod
    def at_least(x: Column, y: Column) -> Column:
        return F.when(~F.isnan(x) & ~F.isnan(y) & (x >= y), F.lit(1.0)).otherwise(F.lit(0.0))


def _flat(m, left, right, out):
    return 0.0, 0.0


_LT, _GT = _compared(lambda x, y: x < y), _compared(lambda x, y: x > y)
_LE, _GE = _compared(lambda x, y: x <= y), _compared(lambda x, y: x >= y)

#: Codes and names of the opcodes.
TABLE = (
    Op(1, "ADD", 2, np.add, lambda x, y: x + y, lambda m, x, y, o: (1.0, 1.0), 1),
    Op(2, "SUB", 2, np.subtract, lambda x, y: x - y, lambda m, x, y, o: (1.0, -1.0), 1),
    Op(3, "MUL", 2, np.multiply, lambda x, y: x * y, lambda m, x, y, o: (y, x), 1),
    Op(4, "DIV", 2, np.divide, divide, lambda m, x, y, o: (m.divide(1 + 0 * y, y), m.divide(-o, y)), 4),
    Op(5, "LOOSE_DIV", 2, np.divide, divide, None, 4),
    Op(6, "POW", 2, np.power, power, lambda m, x, y, o: (y * m.power(x, y - 1), o * m.log(x)), 8),
    Op(7, "LOOSE_POW", 2, lambda x, y: np.power(np.abs(x), y), lambda x, y: power(F.abs(x), y), None, 8),
    Op(8, "MAX", 2, np.maximum, F.greatest, lambda m, x, y, o: (m.at_least(x, y), 1 - m.at_least(x, y)), 1),
    Op(9, "MIN", 2, np.minimum, least, lambda m, x, y, o: (m.at_least(y, x), 1 - m.at_least(y, x)), 1),
    Op(10, "LT", 2, *_LT, _flat, 1),
    Op(11, "GT", 2, *_GT, _flat, 1),
    Op(12, "LE", 2, *_LE, _flat, 1),
    Op(13, "GE", 2, *_GE, _flat, 1),
    Op(14, "SIN", 1, np.sin, F.sin, lambda m, a, o: (m.cos(a),), 8),
    Op(15, "COS", 1, np.cos, F.cos, lambda m, a, o: (-m.sin(a),), 8),
    Op(16, "TAN", 1, np.tan, F.tan, lambda m, a, o: (1 + o * o,), 8),
    Op(17, "SINH", 1, np.sinh, F.sinh, lambda m, a, o: (m.cosh(a),), 8),
    Op(18, "COSH", 1, np.cosh, F.cosh, lambda m, a, o: (m.sinh(a),), 8),
    Op(19, "TANH", 1, np.tanh, F.tanh, lambda m, a, o: (1 - o * o,), 8),
    Op(20, "LOG", 1, np.log, log, lambda m, a, o: (m.divide(1 + 0 * a, a),), 8),
    Op(21, "LOOSE_LOG", 1, lambda a: np.log(np.abs(a)), lambda a: log(F.abs(a)), None, 8),
    Op(22, "EXP", 1, np.exp, F.exp, lambda m, a, o: (o,), 8),
    Op(23, "INV", 1, lambda a: 1 / a, lambda a: divide(F.lit(1.0), a), lambda m, a, o: (-o * o,), 4),
    Op(24, "LOOSE_INV", 1, lambda a: 1 / a, lambda a: divide(F.lit(1.0), a), None, 4),
    Op(25, "NEG", 1, np.negative, lambda a: -a, lambda m, a, o: (-1.0,), 1),
    Op(26, "ABS", 1, np.abs, F.abs, lambda m, a, o: (m.sign(a),), 1),
    Op(27, "SQRT", 1, np.sqrt, F.sqrt, lambda m, a, o: (m.divide(1 + 0 * o, 2 * o),), 4),
    Op(28, "LOOSE_SQRT", 1, lambda a: np.sqrt(np.abs(a)), lambda a: F.sqrt(F.abs(a)), None, 4),
)
BY_CODE = {op.code: op for op in TABLE}
BY_NAME = {op.name: op for op in TABLE}
LOOSE = tuple(op.code for op in TABLE if op.name.startswith("LOOSE"))


def is_finite(x: Column) -> Column:
    """True for finite numbers; false for NaN, infinities and null."""
    return F.coalesce(F.abs(x) < INF, F.lit(False))


def guarded(x: Column, bad: float, low: float | None = None) -> Column:
    """x, with bad for NaN and +inf, and low (bad if not given) for -inf."""
    return F.when(F.isnan(x) | (x == INF), F.lit(bad)).when(x == -INF, F.lit(bad if low is None else low)).otherwise(x)


def residual_guard(x: Column) -> Column:
    """Residuals with 1e10 for NaN and +inf and -1e10 for -inf."""
    return guarded(x, 1e10, -1e10)


def jacobian_guard(x: Column) -> Column:
    return guarded(x, 0.0)


def point_sentinel(x: Column) -> Column:
    return guarded(x, 1e6)


def clamp_zero(x: Column) -> Column:
    """0 for negative and non-finite values and nulls, else the value."""
    return F.when(is_finite(x), F.greatest(x, F.lit(0.0))).otherwise(F.lit(0.0))


def annihilating(a: Column, b: Column) -> Column:
    """A product in which an exact zero beats inf and NaN."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(a * b)


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when((x == 0) | ~is_finite(x), x).otherwise(F.round(x * scale) / scale)


def small_to_zero(x: Column) -> Column:
    """x rounded to three decimals, and 0 below 1e-4."""
    return F.when(F.abs(x) < 1e-4, F.lit(0.0)).otherwise(F.round(x, 3))
