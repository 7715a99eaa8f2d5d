"""Arrays as coordinate DataFrames with their shape.

A tensor of n dimensions has index columns ``i0`` to ``i{n-1}`` (bigint) and a value
column ``v``; indexes are unique.  The first ``dense`` dimensions are dense.  A
tensor without sparse dimensions reads as zero where it holds no row; one with
sparse dimensions holds no zeros and reads only what it holds, unless scanned in full.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero(kind: T.DataType) -> Column:
    """What a missing element of a type reads as."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[zero(f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    dims: tuple[int, ...]
    dense: int
    full: bool = False  # every index is known to have a row
    blocks: Any = field(default=None, compare=False)  # the same matrix in blocks, if it has been made so

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def index(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @property
    def kind(self) -> T.DataType:
        return self.df.schema["v"].dataType

    @property
    def is_sparse(self) -> bool:
        return self.dense < self.rank

    @property
    def rows(self) -> int:
        return self.dims[0]

    @property
    def cols(self) -> int:
        return self.dims[1]

    length = rows

    def cells(self) -> DataFrame:
        """What ``<-`` scans: all indexes of a dense tensor, the rows of a sparse one."""
        return self.df if self.is_sparse or self.full else self.all_cells()

    def all_cells(self) -> DataFrame:
        """What ``<=`` scans: every index, zero where there is no row."""
        if self.full:
            return self.df
        grid = index_grid(self.df.sparkSession, self.dims)
        return grid.join(self.df, self.index, "left").select(*self.index, F.coalesce("v", zero(self.kind)).alias("v"))

    def with_df(self, df: DataFrame, full: bool | None = None) -> Tensor:
        return replace(self, df=df, full=self.full if full is None else full, blocks=None)

    def with_blocks(self, blocks: Any) -> Tensor:
        return replace(self, blocks=blocks)

    def persist(self) -> Tensor:
        return self.with_df(self.df.persist())


def index_grid(spark: SparkSession, dims: tuple[int, ...]) -> DataFrame:
    """All indexes, from one range split over tasks (no join)."""
    total = reduce(lambda a, b: a * b, dims, 1)
    at, columns = F.col("id"), []
    for k in range(len(dims) - 1, -1, -1):
        columns.append((at % dims[k]).alias(f"i{k}"))
        at = F.call_function("div", at, F.lit(dims[k]))
    return spark.range(total).select(*reversed(columns))


def store(df: DataFrame, dims: tuple[int, ...], dense: int, *, unique: bool, full: bool = False) -> Tensor:
    """Rows (i0.., v) as a tensor: indexes out of range are dropped, sparse tensors drop
    zeros, and of rows with one index the greatest value stays (``unique``: there are none)."""
    index = [f"i{k}" for k in range(len(dims))]
    out = df.select(*[F.col(i).cast("bigint") for i in index], "v")
    if not full:
        for i, d in zip(index, dims, strict=True):
            out = out.filter(F.col(i).between(0, d - 1))
    if not unique:
        out = out.groupBy(*index).agg(F.max("v").alias("v"))
    kind = out.schema["v"].dataType
    if dense < len(dims):
        full = False
        if isinstance(kind, T.BooleanType):
            out = out.filter("v")
        elif isinstance(kind, T.NumericType):
            out = out.filter(F.col("v") != 0)
        else:
            out = out.filter(F.col("v").isNotNull())
    return Tensor(out, tuple(dims), dense, full)


def from_table(df: DataFrame, index: list[str], value: str | Column, dims: tuple[int, ...], *, dense: int = 0, combine: str | None = None, unique: bool = False) -> Tensor:
    """A table's columns as a tensor; ``combine`` ("sum", "min", "max", "count") merges rows of one index, ``unique``: there are none."""
    v = F.col(value) if isinstance(value, str) else value
    out = df.select(*[F.col(c).cast("bigint").alias(f"i{k}") for k, c in enumerate(index)], v.alias("v"))
    if combine:
        out = out.groupBy(*[f"i{k}" for k in range(len(index))]).agg(getattr(F, combine)("v").alias("v"))
    return store(out, dims, dense, unique=bool(combine) or unique)


def merge(old: Tensor, new: DataFrame, combine=None) -> Tensor:
    """``old`` with the rows of ``new`` (unique indexes) put in, or combined with what is there.

    Without ``combine`` the new value replaces the old one; else the result is
    combine(old, new) where both exist, and the one that exists elsewhere.
    """
    renamed = new.select(*old.index, F.col("v").alias("w"))
    both = old.df.join(renamed, old.index, "full_outer")
    kind = old.kind
    if combine is None:
        v = F.coalesce("w", "v")
    else:
        v = F.when(F.col("v").isNull(), F.col("w")).when(F.col("w").isNull(), F.col("v")).otherwise(combine(F.col("v"), F.col("w")))
    out = both.select(*old.index, v.cast(kind).alias("v"))
    if old.is_sparse:
        out = store(out, old.dims, old.dense, unique=True).df
    return old.with_df(out)
