"""The blocked encoding of dense matrices, and maps, reductions and products on it.

A blocked matrix is a table (bi, bj, rows, cols, cells): ``cells`` is the block's
row-major float64 array as bytes.  Blocks at the edges are smaller, and every block is
there.  The encoding pays off for dense arrays, where a block's work is one NumPy call;
sparse arrays stay on coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import config
from ..tensor import Tensor, index_grid, store

SCHEMA = "bi bigint, bj bigint, rows int, cols int, cells binary"
NAMES = ["bi", "bj", "rows", "cols", "cells"]
#: Partial results of so many places are kept by a task before they are sent on.
HELD = 16
#: Monoids that blocks are merged with.
FOLDS = {"+": np.add, "*": np.multiply, "min": np.minimum, "max": np.maximum}


@dataclass(frozen=True)
class Blocks:
    df: DataFrame
    dims: tuple[int, int]
    size: int


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


def _rows(batch: pa.RecordBatch, kind: type = np.float64) -> Iterator[tuple]:
    """A batch's rows, binary columns as views of the batch."""
    columns = [c.to_pylist() if not pa.types.is_binary(c.type) else c for c in batch.columns]
    for k in range(batch.num_rows):
        yield tuple(c[k] if isinstance(c, list) else np.frombuffer(c[k].as_buffer(), kind) if c[k].is_valid else None for c in columns)


def pack(m: Tensor, size: int | None = None) -> Blocks:
    """A matrix in blocks: cells are dealt by block and put in place a group at a time."""
    if m.blocks is not None and size in (None, m.blocks.size):
        return m.blocks
    n = size or config.block_dim_size
    height, width = m.dims
    spark = m.df.sparkSession

    def place(table: pa.Table) -> pa.Table:
        bi, bj = table["bi"][0].as_py(), table["bj"][0].as_py()
        shape = (min(n, height - bi * n), min(n, width - bj * n))
        out = np.zeros(shape)
        cells = table.filter(table["i0"].is_valid())
        out[cells["i0"].to_numpy() - bi * n, cells["i1"].to_numpy() - bj * n] = cells["v"].to_numpy()
        return pa.Table.from_batches([_record([(bi, bj, *shape, out.tobytes())])])

    keyed = m.df.select((F.call_function("div", F.col("i0"), F.lit(n))).alias("bi"), (F.call_function("div", F.col("i1"), F.lit(n))).alias("bj"), "i0", "i1", F.col("v").cast("double").alias("v"))
    if not m.full:  # a block without cells is zero, but it is there
        none = [F.lit(None).cast(t).alias(c) for c, t in (("i0", "bigint"), ("i1", "bigint"), ("v", "double"))]
        keyed = keyed.unionByName(index_grid(spark, (-(-height // n), -(-width // n))).select(F.col("i0").alias("bi"), F.col("i1").alias("bj"), *none))
    return Blocks(keyed.groupBy("bi", "bj").applyInArrow(place, SCHEMA), m.dims, n)


def of_arrays(df: DataFrame, key: str, column: str, dims: tuple[int, int], size: int | None = None) -> Blocks:
    """A table with one array a row, in blocks: whole rows are dealt by their block row, and no cell is a row of its own."""
    n = size or config.block_dim_size
    height, width = dims

    def place(table: pa.Table) -> Iterator[pa.Table]:
        bi = table["bi"][0].as_py()
        rows = min(n, height - bi * n)
        out = np.zeros((rows, width))
        kept = table.filter(table["i"].is_valid())
        if kept.num_rows:
            flat = kept["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            out[kept["i"].to_numpy() - bi * n] = flat.reshape(kept.num_rows, width)
        made = [(bi, b, rows, min(n, width - b * n), np.ascontiguousarray(out[:, b * n : (b + 1) * n]).tobytes()) for b in range(-(-width // n))]
        return pa.Table.from_batches([_record(made)])

    i = F.col(key).cast("bigint")
    keyed = df.select(F.call_function("div", i, F.lit(n)).alias("bi"), i.alias("i"), F.col(column).cast("array<double>").alias("v"))
    every = index_grid(df.sparkSession, (-(-height // n),)).select(F.col("i0").alias("bi"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("array<double>").alias("v"))
    return Blocks(keyed.unionByName(every).groupBy("bi").applyInArrow(place, SCHEMA), dims, n)


def unpack(b: Blocks) -> Tensor:
    """A blocked matrix as a dense array of coordinates; no row is shuffled."""
    n = b.size

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, rows, cols, data in _rows(batch):
                step = max(1, (1 << 18) // cols)
                for at in range(0, rows, step):
                    part = data[at * cols : min(rows, at + step) * cols]
                    i, j = np.divmod(np.arange(at * cols, at * cols + len(part)), cols)
                    yield pa.record_batch([pa.array(i + bi * n), pa.array(j + bj * n), pa.array(part)], names=["i0", "i1", "v"])

    made = store(b.df.select(*NAMES).mapInArrow(cells, "i0 bigint, i1 bigint, v double"), b.dims, 2, unique=True, full=True)
    return made.with_blocks(b)


def each(b: Blocks, f: Callable[[np.ndarray], np.ndarray], *, turned: bool = False) -> Blocks:
    """``f`` of every block, ``turned``: of the transposed matrix; no block is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, rows, cols, data in _rows(batch):
                x = data.reshape(rows, cols)
                x = np.broadcast_to(np.asarray(f(x.T if turned else x), np.float64), (cols, rows) if turned else (rows, cols))
                yield _record([(bj, bi, cols, rows, x.tobytes()) if turned else (bi, bj, rows, cols, x.tobytes())])

    return Blocks(b.df.select(*NAMES).mapInArrow(run, SCHEMA), b.dims[::-1] if turned else b.dims, b.size)


def transpose(b: Blocks) -> Blocks:
    return each(b, lambda x: x, turned=True)


def together(a: Blocks, b: Blocks, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Blocks:
    """``f`` of the blocks of one place of two matrices of one shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, rows, cols, x, y in _rows(batch):
                z = np.broadcast_to(np.asarray(f(x.reshape(rows, cols), y.reshape(rows, cols)), np.float64), (rows, cols))
                yield _record([(bi, bj, rows, cols, z.tobytes())])

    met = a.df.join(b.df.select("bi", "bj", F.col("cells").alias("cells2")), ["bi", "bj"]).select(*NAMES, "cells2")
    return Blocks(met.mapInArrow(run, SCHEMA), a.dims, a.size)


def add(a: Blocks, b: Blocks) -> Blocks:
    return together(a, b, np.add)


def along(b: Blocks, op: str, axis: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i0, v): the reduction of ``f`` of each row (axis 0: the index that stays) or column, partial by block, then by index."""
    n, fold = b.size, FOLDS[op]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, rows, cols, data in _rows(batch):
                x = np.broadcast_to(np.asarray(f(data.reshape(rows, cols)), np.float64), (rows, cols))
                v = fold.reduce(x, axis=1 - axis)
                yield pa.record_batch([pa.array(np.arange(len(v)) + (bi, bj)[axis] * n), pa.array(v)], names=["i0", "v"])

    merged = {"+": F.sum, "*": F.product, "min": F.min, "max": F.max}[op]
    return b.df.select(*NAMES).mapInArrow(run, "i0 bigint, v double").groupBy("i0").agg(merged("v").alias("v"))


# ---------------------------------------------------------------- products


def _kernel(op: str, f: Callable | None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What two blocks give: the matrix product (``f`` None), or the reduction along the inner index of ``f``, some of it at a time."""
    if f is None:
        return np.matmul
    fold = FOLDS[op]

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 22) // max(1, x.shape[0] * y.shape[1]))
        out = None
        for k in range(0, x.shape[1], step):
            part = fold.reduce(np.broadcast_to(f(x[:, k : k + step, None], y[None, k : k + step, :]), (x.shape[0], min(step, x.shape[1] - k), y.shape[1])), axis=1)
            out = part if out is None else fold(out, part)
        return out

    return run


def _narrow(df: DataFrame) -> DataFrame:
    """Blocks to be dealt: cells of a block whose every value is one of 32 bits as such, so that no bit is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *place, data in _rows(batch):
                with np.errstate(all="ignore"):
                    half = data.astype(np.float32)
                yield _record([(*place, (half if half.astype(np.float64).tobytes() == data.tobytes() else data).tobytes())])

    return df.select(*NAMES).mapInArrow(run, SCHEMA)


def _wide(data: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """The cells of a block that may have been made narrow."""
    return data.view(np.float32 if len(data) < 8 * rows * cols else np.float64).astype(np.float64, copy=False).reshape(rows, cols)


def _partial(kernel: Callable, fold: np.ufunc, held: int):
    """(bi, bj, rows, inner, cols, x, y): products, those of one place merged while the task holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for bi, bj, r, k, c, x, y in _rows(batch, np.uint8):
                p = kernel(_wide(x, r, k), _wide(y, k, c))
                if (bi, bj) in kept:
                    fold(kept[bi, bj], p, out=kept[bi, bj])
                    continue
                if len(kept) == held:
                    place, total = kept.popitem()
                    yield _record([(*place, *total.shape, total.tobytes())])
                kept[bi, bj] = np.array(p)
        for place, total in kept.items():
            yield _record([(*place, *total.shape, total.tobytes())])

    return run


def _merged(fold: np.ufunc):
    """Blocks in order of place: those of one place as one, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        for batch in batches:
            for bi, bj, r, c, x in _rows(batch):
                if (bi, bj) == place:
                    fold(total, x.reshape(r, c), out=total)
                    continue
                if place is not None:
                    yield _record([(*place, *total.shape, total.tobytes())])
                place, total = (bi, bj), np.array(x.reshape(r, c))
        if place is not None:
            yield _record([(*place, *total.shape, total.tobytes())])

    return run


def multiply(a: Blocks, b: Blocks, op: str = "+", f: Callable | None = None) -> Blocks:
    """The product of two matrices, or of another reduction and function of two cells.

    ``config.group_by_join`` chooses the grid strategy, else blocks are joined on the inner coordinate.
    """
    if a.dims[1] != b.dims[0] or a.size != b.size:
        raise ValueError("the operands' shapes or block sizes do not fit")
    return (_multiply_on_grid if config.group_by_join else _multiply_by_join)(a, b, _kernel(op, f), FOLDS[op])


def _multiply_by_join(a: Blocks, b: Blocks, kernel: Callable, fold: np.ufunc) -> Blocks:
    """Blocks meet on the inner coordinate; products of a place are merged in the task, then after a shuffle.

    Where the inner index has one block only, every product is the whole of its place: products, which may be far larger
    than the operands, are not dealt, and the operands meet on the grid, as they would all meet in one task."""
    if a.dims[1] <= a.size:
        met, _ = _on_grid(a, b, max(-(-a.dims[0] // a.size), -(-b.dims[1] // b.size)))
        return Blocks(met.mapInArrow(_partial(kernel, fold, 1), SCHEMA), (a.dims[0], b.dims[1]), a.size)
    left = a.df.select("bi", F.col("bj").alias("k"), "rows", F.col("cols").alias("inner"), F.col("cells").alias("x"))
    right = b.df.select(F.col("bi").alias("k"), "bj", "cols", F.col("cells").alias("y"))
    if config.use_map_join and a.dims[0] * a.dims[1] <= config.broadcast_rows:  # the size is known from the shape
        left = F.broadcast(left)
    elif config.use_map_join and b.dims[0] * b.dims[1] <= config.broadcast_rows:
        right = F.broadcast(right)
    met = left.join(right, "k").select("bi", "bj", "rows", "inner", "cols", "x", "y")
    parts = _parts(a.df)
    dealt = met.mapInArrow(_partial(kernel, fold, HELD), SCHEMA).repartition(parts, "bi", "bj").sortWithinPartitions("bi", "bj")
    return Blocks(dealt.mapInArrow(_merged(fold), SCHEMA), (a.dims[0], b.dims[1]), a.size)


def _parts(df: DataFrame) -> int:
    return config.number_of_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _multiply_on_grid(a: Blocks, b: Blocks, kernel: Callable, fold: np.ufunc) -> Blocks:
    """Tasks form a grid whose side is the root of their number.  A block of ``a`` goes to the cells of one row of the grid,
    one of ``b`` to those of one column, so each travels side times; the products of a cell's places are merged where they
    are made, and what is left of them after a shuffle."""
    met, parts = _on_grid(a, b)
    dealt = met.mapInArrow(_partial(kernel, fold, HELD), SCHEMA).repartition(parts, "bi", "bj").sortWithinPartitions("bi", "bj")
    return Blocks(dealt.mapInArrow(_merged(fold), SCHEMA), (a.dims[0], b.dims[1]), a.size)


def _on_grid(a: Blocks, b: Blocks, most: int | None = None) -> tuple[DataFrame, int]:
    """Blocks that meet in the cells of a grid, and the number of tasks.  With ``most`` the side is twice as long, but no longer
    than that, and few bytes of operands are still dealt to all tasks, as their products may be many."""
    parts = _parts(a.df)
    side = max(1, math.isqrt(parts)) if most is None else max(1, min(2 * math.isqrt(parts), most))
    every = lambda n: F.explode(F.array(*[F.lit(x) for x in range(side)])).alias(n)
    left = _narrow(a.df).select((F.col("bi") % side).cast("int").alias("r"), every("c"), "bi", F.col("bj").alias("k"), "rows", F.col("cols").alias("inner"), F.col("cells").alias("x"))
    right = _narrow(b.df).select(every("r"), (F.col("bj") % side).cast("int").alias("c"), "bj", F.col("bi").alias("k"), "cols", F.col("cells").alias("y"))
    if most is not None:
        left, right = left.repartition(parts, "r", "c", "k"), right.repartition(parts, "r", "c", "k")
    return left.join(right.hint("merge"), ["r", "c", "k"]).select("bi", "bj", "rows", "inner", "cols", "x", "y"), parts
