"""Array and matrix programs on Spark DataFrames."""

from .api import Tensor, config, explain, from_table, param, parami, parse, q, register_storage, session

__all__ = ["Tensor", "config", "explain", "from_table", "param", "parami", "parse", "q", "register_storage", "session"]
