"""Scalar operators and functions on columns and on plain Python values.

Whole numbers divide to a whole number, rounded towards zero, and a remainder has
the dividend's sign; a fraction divided by zero is an infinity or no number.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_column(x: Any) -> bool:
    return isinstance(x, Column)


def divide(a: Any, b: Any, whole: bool) -> Any:
    if not is_column(a) and not is_column(b):
        if isinstance(a, int) and isinstance(b, int):
            return int(abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
        return a / b
    if whole:
        return F.call_function("div", _column(a), _column(b))
    if not is_column(b) and b != 0:
        return a / b
    b = _column(b).cast("double")
    return F.when(b == 0, _column(a) * F.lit(math.inf)).otherwise(_column(a) / b)


def remainder(a: Any, b: Any) -> Any:
    if not is_column(a) and not is_column(b):
        return math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else int(math.fmod(a, b))
    return _column(a) % _column(b)


def _column(x: Any) -> Column:
    return x if is_column(x) else F.lit(x)


def _both(column: Callable, plain: Callable) -> Callable:
    return lambda *a: column(*map(_column, a)) if any(map(is_column, a)) else plain(*a)


def _xor(a: Column, b: Column) -> Column:
    return a != b


def _search(key: Column, low: Column, high: Column, array: Column) -> Column:
    """Place of a key among the places low to high - 1 of a sorted array, -1 if it is not there."""
    at = F.array_position(F.slice(array, low + 1, F.greatest(high - low, F.lit(0))), key)
    return F.when(at > 0, low + at - 1).otherwise(F.lit(-1)).cast("int")


def _plain_search(key: Any, low: int, high: int, array: list) -> int:
    at = bisect_left(array, key, low, high)
    return at if at < high and array[at] == key else -1


OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "&&": _both(lambda a, b: a & b, lambda a, b: a and b),
    "&": _both(lambda a, b: a & b, lambda a, b: a & b),
    "||": _both(lambda a, b: a | b, lambda a, b: a or b),
    "^": _both(_xor, lambda a, b: a ^ b),
    "%": remainder,
    "++": _both(F.concat, lambda a, b: a + b),
    ":+": _both(lambda a, b: F.array_append(a, b), lambda a, b: [*a, b]),
    "::": _both(lambda a, b: F.array_prepend(b, a), lambda a, b: [a, *b]),
}

FUNCTIONS: dict[str, Callable] = {
    "min": _both(F.least, min),
    "max": _both(F.greatest, max),
    "abs": _both(F.abs, abs),
    "exp": _both(F.exp, math.exp),
    "log": _both(F.log, math.log),
    "sqrt": _both(F.sqrt, math.sqrt),
    "pow": _both(F.pow, math.pow),
    "sin": _both(F.sin, math.sin),
    "cos": _both(F.cos, math.cos),
    "tanh": _both(F.tanh, math.tanh),
    "floor": _both(F.floor, math.floor),
    "ceil": _both(F.ceil, math.ceil),
    "round": _both(F.round, round),
    "inRange": _both(lambda i, a, b, s: (i >= a) & (i <= b) & ((i - a) % s == 0), lambda i, a, b, s: a <= i <= b and (i - a) % s == 0),
    "range": _both(F.sequence, lambda a, b, s=1: list(range(a, b + 1, s))),
    "sort": _both(F.sort_array, sorted),
    "unique_values": _both(F.array_distinct, lambda a: list(dict.fromkeys(a))),
    "array_size": _both(F.size, len),
    "binarySearch": _both(_search, _plain_search),
}

METHODS: dict[str, Callable] = {
    "toDouble": _both(lambda a: a.cast("double"), float),
    "toInt": _both(lambda a: a.cast("int"), int),
    "toLong": _both(lambda a: a.cast("bigint"), int),
    "toString": _both(lambda a: a.cast("string"), str),
    "abs": FUNCTIONS["abs"],
    "contains": _both(lambda a, b: F.array_contains(a, b), lambda a, b: b in a),
    "toList": _both(lambda a: F.map_entries(a), lambda a: list(a.items()) if isinstance(a, dict) else list(a)),
    "toMap": _both(lambda a: F.map_from_entries(a), dict),
    "length": _both(F.size, len),
    "size": _both(F.size, len),
}

CONSTANTS: dict[tuple[str, str], Any] = {
    ("Double", "MaxValue"): 1.7976931348623157e308,
    ("Double", "MinValue"): -1.7976931348623157e308,
    ("Double", "PositiveInfinity"): math.inf,
    ("Double", "NegativeInfinity"): -math.inf,
    ("Int", "MaxValue"): 2**31 - 1,
    ("Int", "MinValue"): -(2**31),
    ("Long", "MaxValue"): 2**63 - 1,
    ("Long", "MinValue"): -(2**63),
    ("Math", "PI"): math.pi,
    ("Math", "E"): math.e,
}

TYPES = {"Int": "int", "Long": "bigint", "Double": "double", "Float": "float", "Boolean": "boolean", "String": "string", "Char": "string"}

#: Monoids: aggregate of a column, fold of two columns, value of an empty bag, fold of plain values.
MONOIDS: dict[str, tuple[Callable, Callable, Any, Callable]] = {
    "+": (F.sum, lambda a, b: a + b, 0, lambda a, b: a + b),
    "*": (F.product, lambda a, b: a * b, 1, lambda a, b: a * b),
    "max": (F.max, lambda a, b: F.greatest(a, b), None, max),
    "min": (F.min, lambda a, b: F.least(a, b), None, min),
    "&&": (F.bool_and, lambda a, b: a & b, True, lambda a, b: a and b),
    "||": (F.bool_or, lambda a, b: a | b, False, lambda a, b: a or b),
    "++": (lambda c: F.flatten(F.collect_list(c)), lambda a, b: F.concat(a, b), [], lambda a, b: a + b),
}


def aggregate(op: str, column: Column, kind: T.DataType, user: Callable | None = None) -> Column:
    """Reduction of a group's values; a product of whole numbers is folded exactly, and so is a user's function."""
    whole = isinstance(kind, T.IntegralType)
    if user is not None:
        values = F.collect_list(column)
        return F.reduce(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: user(a, x))
    if op == "*" and whole:
        return F.aggregate(F.collect_list(column.cast("bigint")), F.lit(1).cast("bigint"), lambda a, x: a * x)
    return MONOIDS[op][0](column)
