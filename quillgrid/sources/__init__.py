"""Where arrays come from: tables as tensors, and text files of edges or cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import of_arrays
from ..tensor import Tensor, from_table, store


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def edges(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(src, dst) of a text file of edges."""
    return spark.read.csv(path, sep=separator, schema="src bigint, dst bigint")


def coordinates(spark: SparkSession, path: str, dims: tuple[int, ...], *, separator: str = ",", dense: int = 0) -> Tensor:
    """A tensor of a text file with one cell a line: indexes, then the value."""
    index = ", ".join(f"i{k} bigint" for k in range(len(dims)))
    return store(spark.read.csv(path, sep=separator, schema=f"{index}, v double"), dims, dense, unique=False)


def vectors(df: DataFrame, key: str, column: str, dims: tuple[int, int], *, full: bool = False) -> Tensor:
    """A dense matrix of a table with one array a row; ``full``: every row from 0 on is there once, with an array of full length."""
    cells = df.select(F.col(key).cast("bigint").alias("i0"), F.posexplode(column).alias("i1", "v"))
    made = store(cells.select("i0", F.col("i1").cast("bigint").alias("i1"), F.col("v").cast("double").alias("v")), dims, 2, unique=True, full=full)
    return made.with_blocks(of_arrays(df, key, column, dims)) if full else made


__all__ = ["coordinates", "edges", "from_table", "table", "vectors"]
