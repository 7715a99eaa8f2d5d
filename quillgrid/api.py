"""Running programs of the array language."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .lang.parser import parse
from .plans.program import Program, register_storage
from .session import config, parami, param, session
from .tensor import Tensor, from_table

__all__ = ["Tensor", "config", "explain", "from_table", "param", "parami", "parse", "q", "register_storage", "session"]


def q(program: str, *, spark: SparkSession | None = None, **names: Any) -> Any:
    """Run a program and return the value of its last statement.

    ``names`` are what the program takes from its surroundings: tensors, DataFrames,
    lists, maps, numbers, and functions of columns (ordinary Python callables).
    Arrays come back as ``Tensor``, bags as DataFrames, total reductions as values.
    """
    spark = spark or SparkSession.getActiveSession() or session()
    return Program(spark, dict(names)).run(parse(program, [n for n, v in names.items() if callable(v)]))


def explain(value: Tensor | DataFrame, mode: str = "formatted") -> None:
    """Print the physical plan of a result."""
    (value.df if isinstance(value, Tensor) else value).explain(mode)
