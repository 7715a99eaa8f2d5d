import numpy as np
import pytest

from quillgrid import config, from_table, param, parami, q
from quillgrid.operators import algorithms, blocks
from quillgrid.sources import vectors


def matrix(spark, n, m, shape="(n,m)"):
    return q(f"tensor{shape}[ ((i,j),((i*7+j*3)%10)*1.0) | i <- 0..n-1, j <- 0..m-1 ]", spark=spark, n=n, m=m)


def dense(x):
    out = np.zeros(x.dims)
    for r in x.df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_products(spark, grid, limit):
    a, b = matrix(spark, 10, 7), matrix(spark, 7, 9)
    before = config.group_by_join, config.broadcast_rows
    config.group_by_join, config.broadcast_rows = grid, limit
    try:
        got = dense(blocks.unpack(blocks.multiply(blocks.pack(a, 4), blocks.pack(b, 4))))
    finally:
        config.group_by_join, config.broadcast_rows = before
    assert np.array_equal(got, dense(a) @ dense(b))


def test_products_of_one_inner_block_are_not_dealt(spark):
    a, b = matrix(spark, 22, 3), matrix(spark, 3, 17)
    before = config.broadcast_rows
    try:
        for config.broadcast_rows in (0, 1_000_000):
            made = blocks.multiply(blocks.pack(a, 4), blocks.pack(b, 4))
            assert np.array_equal(dense(blocks.unpack(made)), dense(a) @ dense(b))
            text = made.df._jdf.queryExecution().optimizedPlan().toString()
            assert text.splitlines()[0].startswith("MapInArrow") and "Join" in text.splitlines()[2]
    finally:
        config.broadcast_rows = before


def test_operands_of_short_fractions_are_dealt_at_half_their_size(spark):
    rng = np.random.default_rng(3)
    whole = rng.normal(size=(21, 3))
    short = whole.astype(np.float32).astype(np.float64)
    short[0], short[9] = (np.inf, -0.0, np.nan), (2.0**100, 2.0**-149, 0)
    for x, size in ((short, 4), (whole, 8)):
        a = blocks.pack(from_table(spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "i long, j long, v double"), ["i", "j"], "v", x.shape, dense=2), 4)
        met, _ = blocks._on_grid(a, blocks.transpose(a), 6)
        for r in met.collect():
            assert (len(r["x"]), len(r["y"])) == (size * r["rows"] * r["inner"], size * r["inner"] * r["cols"])
        with np.errstate(all="ignore"):
            assert np.allclose(dense(blocks.unpack(blocks.multiply(a, blocks.transpose(a)))), x @ x.T, rtol=1e-14, atol=1e-14, equal_nan=True)


def test_round_trip_and_sum(spark):
    a, b = matrix(spark, 10, 7), matrix(spark, 10, 7, "()(n,m)")
    assert np.array_equal(dense(blocks.unpack(blocks.pack(a, 4))), dense(a))
    assert np.array_equal(dense(blocks.unpack(blocks.add(blocks.pack(a, 4), blocks.pack(b, 4)))), 2 * dense(a))
    # blocks without a cell are there as well
    few = q("tensor(10,7)[ ((i,i),1.0) | i <- 0..2 ]", spark=spark)
    assert blocks.pack(few, 4).df.count() == 6 and dense(blocks.unpack(blocks.pack(few, 4))).sum() == 3


@pytest.fixture
def small_blocks():
    before = config.block_dim_size
    config.block_dim_size = 4
    yield
    config.block_dim_size = before


def vectors_of(spark, x):
    return vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, a array<double>"), "k", "a", x.shape, full=True)


def test_blocked_programs(spark, small_blocks):
    """tensor* over dense matrices runs block by block and gives what coordinates give."""
    rng = np.random.default_rng(3)
    X, Y, Z = rng.integers(-5, 6, (10, 7)) / 2, rng.integers(-5, 6, (9, 7)) / 2, rng.integers(-5, 6, (10, 7)) / 2
    names = {"X": vectors_of(spark, X), "Y": vectors_of(spark, Y), "Z": vectors_of(spark, Z), "c": 3}
    cases = [
        ("tensor*(10,9)[ ((i,j),+/p) | ((i,k),x) <- X, ((j,kk),y) <- Y, kk == k, let p = x*y, group by (i,j) ]", X @ Y.T),
        ("tensor*(9,10)[ ((j,i),+/p) | ((i,k),x) <- X, ((j,kk),y) <- Y, k == kk, let p = y*x, group by (i,j) ]", Y @ X.T),
        ("tensor*(7,7)[ ((i,j),+/p) | ((k,i),x) <- X, ((kk,j),z) <- Z, kk == k, let p = x*z, group by (i,j) ]", X.T @ Z),
        ("tensor*(10,9)[ ((i,j),min/p) | ((i,k),x) <- X, ((j,kk),y) <- Y, kk == k, let p = x+y*c, group by (i,j) ]", (X[:, None, :] + 3 * Y[None, :, :]).min(2)),
        ("tensor*(10,9)[ ((i,j),max/p) | ((i,k),x) <- X, ((j,kk),y) <- Y, kk == k, let d = x-y, let p = d*d, group by (i,j) ]", ((X[:, None, :] - Y[None, :, :]) ** 2).max(2)),
        ("tensor*(10,7)[ ((i,j),if (x > 0.0) exp(x)/c else -x) | ((i,j),x) <- X ]", np.where(X > 0, np.exp(X) / 3, -X)),
        ("tensor*(7,10)[ ((j,i),x*2) | ((i,j),x) <- X ]", 2 * X.T),
        ("tensor*(10,7)[ ((i,j),x*z-1.0) | ((i,j),x) <- X, ((ii,jj),z) <- Z, ii == i, jj == j ]", X * Z - 1),
        ("tensor*(10)[ (i,+/p) | ((i,j),x) <- X, let p = x*x, group by i ]", (X * X).sum(1)),
        ("tensor*(7)[ (j,min/x) | ((i,j),x) <- X, group by j ]", X.min(0)),
    ]
    for text, want in cases:
        got = q(text, spark=spark, **names)
        assert np.allclose(dense(got), want), text
        assert "MapInArrow" in got.df._jdf.queryExecution().optimizedPlan().toString() and got.full, text
        assert np.allclose(dense(q(text.replace("tensor*", "tensor"), spark=spark, **names)), want), text
    # results stay blocked, and what has no form of blocks stays on coordinates
    twice = q("var A = tensor*(10,9)[ ((i,j),+/p) | ((i,k),x) <- X, ((j,kk),y) <- Y, kk == k, let p = x*y, group by (i,j) ]; tensor*(10,9)[ ((i,j),1.0-a) | ((i,j),a) <- A ];", spark=spark, **names)
    assert twice.blocks is not None and np.allclose(dense(twice), 1 - X @ Y.T)
    for text in ("tensor*(10,7)[ ((i,j),x) | ((i,j),x) <- X, x > 0.0 ]", "tensor*(10,7)[ ((i,j),x+i) | ((i,j),x) <- X ]", "tensor*(10)(7)[ ((i,j),x) | ((i,j),x) <- X ]", "tensor*(10,7)[ (((i+1)%10,j),x) | ((i,j),x) <- X ]"):
        assert q(text, spark=spark, **names).blocks is None


def test_switches(spark, small_blocks):
    a = matrix(spark, 10, 7)
    for name in ("use_map_join", "parallel", "mapPreserve", "data_frames"):
        param(name, False)
    try:
        plan = lambda: blocks.multiply(blocks.pack(a), blocks.transpose(blocks.pack(a))).df._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" not in plan()
        param("use_map_join", True)
        assert "broadcast" in plan()
    finally:
        param("use_map_join", True)
    parami("block_dim_size", 5)
    assert blocks.pack(a).df.count() == 4
    for bad in (lambda: param("none", True), lambda: parami("none", 1)):
        with pytest.raises(KeyError):
            bad()


def ranks(e, rounds):
    out = e.sum(1, keepdims=True)
    v = np.full(len(e), 1 / len(e))
    for _ in range(rounds):
        v = 0.15 / len(e) + 0.85 * (e / np.where(out > 0, out, 1)).T @ v
    return v


def test_algorithms(spark):
    a = matrix(spark, 5, 5)
    assert np.array_equal(dense(algorithms.multiply(a, a, dense=2, spark=spark)), dense(a) @ dense(a))
    rng = np.random.default_rng(8)
    e = (rng.random((7, 7)) < 0.35).astype(float)
    e[4] = 0
    edges = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(e), strict=True)], "src long, dst long")
    for algorithm in (algorithms.pagerank, algorithms.pagerank_of_lists):
        got = algorithm(edges, 7, rounds=3, spark=spark)
        assert np.allclose(dense(got), ranks(e, 3))


def test_factors(spark):
    rng = np.random.default_rng(9)
    R = rng.integers(0, 5, (6, 5)) * (rng.random((6, 5)) < 0.6)
    P, Q = rng.random((6, 2)), rng.random((2, 5))
    E = np.where(R != 0, R - P @ Q, 0)
    want = P + 0.1 * (2 * E @ Q.T - 0.5 * P), Q + 0.1 * (2 * P.T @ E - 0.5 * Q)
    rows = spark.createDataFrame([(i, j, float(R[i, j])) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(R)), strict=True)], "i int, j int, v double")
    r = from_table(rows, ["i", "j"], "v", (6, 5), combine="sum")
    for algorithm in (algorithms.factorize_step, algorithms.factorize_in_loops):
        for got, x in zip(algorithm(r, vectors_of(spark, P), vectors_of(spark, Q), rate=0.1, shrink=0.5, spark=spark), want, strict=True):
            assert np.allclose(dense(got), x)


def test_network(spark, small_blocks):
    rng = np.random.default_rng(10)
    X, T = rng.normal(size=(12, 5)), (rng.random((12, 1)) < 0.5).astype(float)
    W = [rng.normal(size=s) for s in ((5, 6), (6, 3), (3, 1))]
    O = [X]
    for k, w in enumerate(W):
        z = O[-1] @ w
        O.append(1 / (1 + np.exp(-z)) if k == 2 else np.maximum(z, 0))
    error, want = O[-1] - T, [None] * 3
    for k in (2, 1, 0):
        want[k] = W[k] - 0.3 * O[k].T @ error / 12
        error = (error @ W[k].T) * (O[k] > 0)
    got = algorithms.train_step(vectors_of(spark, X), vectors_of(spark, T), [vectors_of(spark, w) for w in W], rate=0.3, spark=spark)
    assert all(np.allclose(dense(g), w) for g, w in zip(got, want, strict=True))
    assert np.allclose(dense(algorithms.forward(vectors_of(spark, X), [vectors_of(spark, w) for w in W], spark=spark)), O[-1])
