"""Packing into optimal length buckets.

The lengths' global histogram is reduced by a dynamic program to at most
``buckets`` boundaries that minimise the total padding; inside each bucket, rows
form batches of ``token_budget // boundary`` rows, one at least.  One law holds for all
rows: one that is longer than the budget is a bucket's row like any other, and the only
one of its batch.

The driver reads the histogram: one row for each length that occurs, so its size is
bounded by the longest row's length and does not grow with the number of rows.

Defined results: a null text has length 0, a null length as well; ties in length share a
bucket; repeated rows are numbered by their position in the staged table; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import gapless_rank, stage

WORD = r"[^\x20\x09-\x0D]+"


def word_length(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bpe_lengths(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, length) in tokens of a ``tokenizers`` JSON file that every executor can open; a null text has none."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(tokenizer)
        coder.encode_special_tokens = True
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            sizes = [len(e.ids) for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], names=["key", "length"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(count, f"key {kind}, length long").withColumnRenamed("key", key)


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (each the largest length of its bucket) with the least total padding.

    f_k(j) = min over i < j of f_{k-1}(i) + L_j (N_j - N_i) - (S_j - S_i).  In i this
    is a lower envelope of lines with slopes -N_i, queried at rising L_j.
    """
    m = len(lengths)
    if not m:
        return []
    L = [int(x) for x in lengths]
    N, S = [0], [0]
    for x, c in zip(L, counts, strict=True):
        N.append(N[-1] + int(c))
        S.append(S[-1] + int(c) * x)
    best = [0] + [L[j] * N[j + 1] - S[j + 1] for j in range(m)]
    came: list[list[int]] = [[0] * (m + 1)]
    k = 1
    while k < min(buckets, m) and best[m]:
        now, source = [0] * (m + 1), [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, offset, i
        head = 0
        for j in range(1, m + 1):
            line = (-N[j - 1], best[j - 1] + S[j - 1], j - 1)
            while len(hull) - head >= 2 and _hidden(hull[-2], hull[-1], line):
                hull.pop()
            hull.append(line)
            x = L[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            now[j] = hull[head][0] * x + hull[head][1] + x * N[j] - S[j]
            source[j] = hull[head][2]
        best = now
        came.append(source)
        k += 1
    bounds, j = [], m
    for source in reversed(came):
        bounds.append(L[j - 1])
        j = source[j]
        if not j:
            break
    return bounds[::-1]


def _hidden(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c (slopes falling from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(lengths: DataFrame, *, key: str = "doc_id", length: str = "length", buckets: int = 16, token_budget: int = 16384, bins: int = 256) -> DataFrame:
    """(key, length, bucket, padded, batch, place): batches of a bucket run from 0,
    places within a batch from 0; ``padded`` is the length after padding."""
    rows = stage(
        lengths.select(F.col(key).alias("key"), F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long")).alias("length"), F.monotonically_increasing_id().alias("row")).withColumn(
            "bin", F.pmod(F.xxhash64("key", "row"), F.lit(bins))
        ),
        "pack-lengths",
    )
    found = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each length
    found.sort()
    bounds = bucket_bounds(np.array([r[0] for r in found]), np.array([r[1] for r in found]), buckets)
    bucket, padded = F.lit(None), F.lit(None)
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("length") <= bounds[k]
        bucket = F.when(inside, F.lit(k)).otherwise(bucket)
        padded = F.when(inside, F.lit(bounds[k])).otherwise(padded)
    rows = rows.withColumns({"bucket": bucket.cast("int"), "padded": padded.cast("long")})
    ranked = gapless_rank(rows, "bucket", ["key", "row"], bins)
    size = F.greatest(F.lit(1), F.expr(f"{token_budget} div greatest(padded, 1)"))
    return ranked.select(
        F.col("key").alias(key),
        "length",
        "bucket",
        "padded",
        F.floor(F.col("rank") / size).cast("long").alias("batch"),
        (F.col("rank") % size).cast("int").alias("place"),
    )
