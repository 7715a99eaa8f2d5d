"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: every vector is centred on its nearest centroid, rotated by a fixed random
orthogonal matrix and kept as one sign bit a dimension, with three correction
scalars: the residual's norm, the inner product of the unit residual with its
code, and the centroid.  Only centroids are fitted, on ``sample_rows`` vectors.

Search: the inner product of a query with a vector is estimated from the bits and
scalars, within an error bound that holds with high probability.  A task keeps the
20 best exact scores of each query; only vectors whose upper bound reaches the
lowest of them, or the 20th lower bound, are reranked in double precision; products are
added from the first component to the last, so that equal vectors tie on any machine.

Queries come in blocks of about ``block_rows`` that are sent to all tasks; the
index is never collected, and each task returns ``k`` rows a query.

Defined results: a row with a null id, or a vector that is null, empty, zero or
holds null or non-finite components, takes no part; vectors are compared with those
of their own length; a query's own row is any row with its id; of query rows with
one id the smallest vector counts; ties go to the smaller id; repeated candidate
rows all count; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

CODE = "id long, dim int, vector array<double>, code binary, centroid int, norm double, agreement double"


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(vectors: DataFrame, *, count: int = 16, sample_rows: int = 5_000, rounds: int = 8) -> dict[int, np.ndarray]:
    """Centroids by vector length, by Lloyd's rounds on the rows with the smallest hashes."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["vector"]), []).append(r["vector"])
    out = {}
    for dim, found in by.items():
        x = np.array(found)
        c = x[:: max(1, len(x) // count)][:count].copy()
        for _ in range(rounds):
            near = (((x**2).sum(1)[:, None] - 2 * x @ c.T) + (c**2).sum(1)).argmin(1)
            for k in range(len(c)):
                if (near == k).any():
                    c[k] = x[near == k].mean(0)
        out[dim] = c
    return out


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
    return flat[starts[rows][:, None] + np.arange(dim)]


def build_index(table: DataFrame, *, key: str, vector: str, centroids: dict[int, np.ndarray] | None = None) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(index, centroids): one row of CODE for each usable row of the table."""
    rows = table.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    if centroids is None:
        centroids = fit_centroids(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x, c = _matrix(b.column(1), at, dim), centroids.get(int(dim), np.zeros((1, dim)))
                near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
                residual = x - c[near]
                norm = np.linalg.norm(residual, axis=1)
                turned = residual / np.where(norm > 0, norm, 1)[:, None] @ rotation(dim)
                sign = turned >= 0
                agreement = np.where(norm > 0, (np.abs(turned).sum(1)) / np.sqrt(dim), 1.0)
                bits = np.packbits(sign, axis=1)
                yield pa.record_batch(
                    [
                        b.column(0).take(pa.array(at)),
                        pa.array(np.full(len(at), dim, np.int32)),
                        b.column(1).take(pa.array(at)),
                        pa.array([r.tobytes() for r in bits], pa.binary()),
                        pa.array(near.astype(np.int32)),
                        pa.array(norm),
                        pa.array(agreement),
                    ],
                    names=["id", "dim", "vector", "code", "centroid", "norm", "agreement"],
                )

    return stage(rows.mapInArrow(encode, CODE), "ann-index"), centroids


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(query):
            return
        some = np.unique(query)
        old = np.repeat(some, self.k)
        q = np.concatenate([old, query])
        s = np.concatenate([self.score[some].ravel(), score])
        i = np.concatenate([self.id[some].ravel(), ident])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, some)
        take = first[:, None] + np.arange(self.k)
        self.score[some], self.id[some] = s[take], i[take]


def search(index: DataFrame, queries: DataFrame, centroids: dict[int, np.ndarray], *, key: str, vector: str, k: int = 20, block_rows: int = 8_192, epsilon: float = 2.5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of the index by inner product."""
    asked = queries.filter(usable(vector) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("vector"))
    blocks = -(-asked.count() // block_rows)
    parts = []
    for n in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).collect()  # about block_rows
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(r["vector"]) for r in block}:
            own = [r for r in block if len(r["vector"]) == dim]
            by[dim] = np.array([r["id"] for r in own]), np.array([r["vector"] for r in own])
        found = index.mapInArrow(_scan(by, centroids, k, epsilon), "query_id long, vec_id long, score double")
        parts.append(found if blocks == 1 else stage(found, "ann-block"))
    if not parts:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(by: dict, centroids: dict, k: int, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: _Best(len(ids), k) for dim, (ids, _) in by.items()}
        ready = {}
        for dim, (_, q) in by.items():
            c = centroids.get(dim, np.zeros((1, dim)))
            ready[dim] = (q @ rotation(dim)).astype(np.float32), (q @ c.T).astype(np.float32), np.linalg.norm(q, axis=1).astype(np.float32)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                dims = b.column(1).to_numpy()
                for dim in np.unique(dims):
                    if int(dim) in by:
                        _block(b, np.flatnonzero(dims == dim), int(dim), by[int(dim)], ready[int(dim)], best[int(dim)], epsilon)
        for dim, (ids, _) in by.items():
            x = best[dim]
            q, j = np.nonzero(x.score > -np.inf)
            yield pa.record_batch([pa.array(ids[q]), pa.array(x.id[q, j]), pa.array(x.score[q, j])], names=["query_id", "vec_id", "score"])

    return run


def _block(b: pa.RecordBatch, rows: np.ndarray, dim: int, asked: tuple, ready: tuple, best: _Best, epsilon: float) -> None:
    ids, q = asked
    turned, centred, size = ready
    ident = b.column(0).to_numpy()[rows]
    x = _matrix(b.column(2), rows, dim)
    codes = np.frombuffer(b"".join(b.column(3).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
    sign = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    centroid = b.column(4).to_numpy()[rows]
    norm, agreement = b.column(5).to_numpy()[rows], np.maximum(b.column(6).to_numpy()[rows], 1e-9)
    scale = (norm / (np.sqrt(dim) * agreement)).astype(np.float32)
    spread = (norm * np.sqrt(np.maximum(0, 1 / agreement**2 - 1)) * epsilon / np.sqrt(max(1, dim - 1)) + 1e-6).astype(np.float32)
    step = max(1, 4_000_000 // max(1, len(rows)))
    for lo in range(0, len(ids), step):
        part = slice(lo, lo + step)
        estimate = turned[part] @ (sign * scale[:, None]).T + centred[part][:, centroid]
        margin = size[part][:, None] * spread
        floor = best.score[part, -1]
        if len(rows) > best.k:
            lower = np.partition(estimate - margin, len(rows) - best.k - 1, axis=1)[:, len(rows) - best.k - 1]  # one below: the query's own row may be among them
            floor = np.maximum(floor, lower)
        qs, js = np.nonzero(estimate + margin >= floor[:, None])
        qs += lo
        keep = ids[qs] != ident[js]
        qs, js = qs[keep], js[keep]
        for s in range(0, len(qs), 50_000):
            u, v = qs[s : s + 50_000], js[s : s + 50_000]
            exact = np.cumsum(q[u] * x[v], axis=1)[:, -1] + 0.0
            better = exact >= best.score[u, -1]
            best.add(u[better], exact[better], ident[v][better])
