"""The parser, and programs on small tables of readings, against NumPy."""

import numpy as np
import pytest

from quillgrid import from_table, q
from quillgrid.lang import tree as t
from quillgrid.lang.parser import ParseError, parse
from quillgrid.plans.lower import LoweringError
from quillgrid.plans.program import LoopError

# Readings of seven sensors on five days, of which some are missing, and a weight for each sensor.
DAYS, SENSORS = 5, 7
_random = np.random.default_rng(42)
READ = _random.integers(-9, 10, (DAYS, SENSORS)) * (_random.random((DAYS, SENSORS)) < 0.6) / 2
WEIGHT = _random.integers(1, 6, SENSORS) / 4


def dense(x):
    out = np.zeros(x.dims)
    for r in x.df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def arrays(spark, shape=0):
    """The readings with ``shape`` dense dimensions, and the weights."""
    rows = [(d, s, float(READ[d, s])) for d in range(DAYS) for s in range(SENSORS) if READ[d, s]]
    read = from_table(spark.createDataFrame(rows, "day int, sensor int, x double"), ["day", "sensor"], "x", (DAYS, SENSORS), dense=shape, combine="sum")
    weight = from_table(spark.createDataFrame([(s, float(w)) for s, w in enumerate(WEIGHT)], "sensor int, w double"), ["sensor"], "w", (SENSORS,), dense=1, combine="sum")
    return {"R": read, "W": weight, "days": DAYS, "sensors": SENSORS}


def run(spark, text, shape=0, **names):
    return q(text, spark=spark, **{**arrays(spark, shape), **names})


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def expression(text):
    return parse(text).parts[0].value


def test_precedence():
    assert expression("-a+b") == t.Unary("-", t.Binary("+", t.Name("a"), t.Name("b")))
    assert expression("a < b == c").op == "<"  # == binds tighter
    assert expression("a || b && c").op == "||"
    assert expression("1..n-1") == t.Range(t.Const(1), t.Binary("-", t.Name("n"), t.Const(1)))
    assert expression("x::y::z").right.op == "::"
    assert expression("(+/m)/m.length").op == "/"
    assert expression("&&/x") == t.Reduce("&&", t.Name("x"))
    assert expression("a-b-c").left.op == "-"


def test_syntax_errors():
    for bad in ("[ x | ", "for i = 0 do x", "var = 1", "e match { case }"):
        with pytest.raises(ParseError):
            parse(bad)


@pytest.mark.parametrize("shape", [0, 1, 2])
@pytest.mark.parametrize("made", ["tensor(sensors,days)", "tensor(sensors)(days)", "tensor()(sensors,days)"])
def test_every_storage_to_every_storage(spark, shape, made):
    got = run(spark, made + "[ ((s,d),3*x-1) | ((d,s),x) <- R, x < 0.0 ]", shape)
    assert np.array_equal(dense(got), np.where(READ < 0, 3 * READ - 1, 0).T)


def test_scans_of_missing_readings(spark):
    present = run(spark, "[ x | ((d,s),x) <- R ]")
    assert present.count() == (READ != 0).sum()
    assert run(spark, "[ x | ((d,s),x) <= R ]").count() == READ.size == run(spark, "[ x | ((d,s),x) <- R ]", 2).count()
    scaled = run(spark, "tensor(days,sensors)[ ((d,s),w-x) | ((d,s),x) <= R, (k,w) <- W, k == s ]")
    assert np.array_equal(dense(scaled), WEIGHT - READ)


def test_products(spark):
    by_day = run(spark, "tensor(days)[ (d,+/p) | ((d,s),x) <- R, (k,w) <- W, k == s, let p = x*w, group by d ]")
    assert np.allclose(dense(by_day), READ @ WEIGHT)
    for shape in (0, 2):
        likeness = run(spark, "tensor(sensors,sensors)[ ((s,o),+/p) | ((d,s),x) <- R, ((e,o),y) <- R, e == d, let p = x*y, group by (s,o) ]", shape)
        assert np.allclose(dense(likeness), READ.T @ READ)


def test_groups(spark):
    assert np.array_equal(dense(run(spark, "tensor(sensors)[ (s,min/x) | ((d,s),x) <- R, group by s ]", 2)), READ.min(0))
    parity = run(spark, "[ (p,x.length,+/x) | ((d,s),x) <- R, group by p: (d+s)%2, x.length > 1 ]")
    want = [[READ[d, s] for d in range(DAYS) for s in range(SENSORS) if (d + s) % 2 == p and READ[d, s]] for p in (0, 1)]
    assert sorted(map(tuple, parity.collect())) == [(p, len(w), sum(w)) for p, w in enumerate(want)]
    # a mean of two indexes a group, into an array
    halves = run(spark, "tensor(2,sensors)[ ((h,s),(+/x)/x.length) | ((d,s),x) <- R, group by (h,s): (d/3,s) ]", 2)
    assert np.allclose(dense(halves), [READ[:3].mean(0), READ[3:].mean(0)])


def test_groups_of_nothing(spark):
    assert run(spark, "[ +/x | ((d,s),x) <- R, x > 99.0, let k = 1, group by k ]").collect() == []
    assert [r[0] for r in run(spark, '[ x.length | ((d,s),x) <- R, let k = "a", group by k ]').collect()] == [(READ != 0).sum()]
    assert run(spark, "+/[ x | ((d,s),x) <- R, x > 99.0 ]") == 0
    assert run(spark, "max/[ x | ((d,s),x) <- R ]") == READ.max()


def test_plans_without_work(spark, tmp_path):
    """A group of one row is no aggregate, a second scan of an array and a range over it are no joins."""
    r = arrays(spark)["R"]
    r.df.write.parquet(str(tmp_path / "r"))
    r = r.with_df(spark.read.parquet(str(tmp_path / "r")))
    one = q("[ (s,d,max/x) | ((d,s),x) <- R, group by (s,d) ]", spark=spark, R=r)
    assert "Aggregate" not in plan(one) and one.count() == (READ != 0).sum()
    twice = q("[ (d,s,x*y) | ((d,s),x) <- R, ((e,o),y) <- R, e == d, o == s ]", spark=spark, R=r)
    assert "Join" not in plan(twice) and sorted(x[2] for x in twice.collect()) == sorted(READ[READ != 0] ** 2)
    window = q("[ (d,s,x) | d <- 2..3, ((e,s),x) <- R, e == d-1 ]", spark=spark, R=r)
    assert "Range" not in plan(window) and "Join" not in plan(window)
    assert {(x[0], x[1]) for x in window.collect()} == {(d, s) for d in (2, 3) for s in range(SENSORS) if READ[d - 1, s]}


def test_full_arrays_are_not_filled_again(spark):
    full = q("tensor(4,3)[ ((i,j),i-j) | i <- 0..3, j <- 0..2 ]", spark=spark)
    # one join: that of the two ranges the array is made of
    assert full.full and plan(q("tensor(4,3)[ ((i,j),v*v) | ((i,j),v) <- A ]", spark=spark, A=full).cells()).count("Join") == 1
    turned = q("tensor(3,4)[ ((j,i),v) | ((i,j),v) <- A ]", spark=spark, A=full)
    sums = q("tensor(4)[ (i,+/v) | ((i,j),v) <- A, group by i ]", spark=spark, A=full)
    assert turned.full and sums.full and np.array_equal(dense(sums), [4 * 0 - 3, 0, 3, 6])
    for text in ("tensor(4,3)[ ((i,j),v) | ((i,j),v) <- A, v > 0 ]", "tensor(5,3)[ ((i,j),v) | ((i,j),v) <- A ]", "tensor(4,3)[ ((3-i,j),v) | ((i,j),v) <- A ]", "tensor(4,4)[ ((i,i),v) | ((i,j),v) <- A ]"):
        assert not q(text, spark=spark, A=full).full
    assert not run(spark, "tensor(sensors)[ (s,+/x) | ((d,s),x) <- R, group by s ]").full


def test_neighbourhoods(spark):
    got = run(spark, "tensor(days,sensors)[ ((e,s),max/x) | ((d,s),x) <- R, k <- 0..2, let e = d+k, group by (e,s) ]", 2)
    assert np.array_equal(dense(got), [READ[max(0, d - 2) : d + 1].max(0) for d in range(DAYS)])


def test_reductions_beside_the_row(spark):
    above = run(spark, "[ (d,s) | ((d,s),x) <- R, x*x > (+/[ y*y | ((e,o),y) <- R, o == s ])/2.0 ]")
    assert {tuple(r) for r in above.collect()} == {(d, s) for d in range(DAYS) for s in range(SENSORS) if READ[d, s] ** 2 > (READ[:, s] ** 2).sum() / 2}
    # by an inequality, and by a predicate over both sides
    earlier = run(spark, "[ (d,s,+/[ y | ((e,o),y) <- R, o == s, e < d ]) | ((d,s),x) <- R ]")
    assert {tuple(r) for r in earlier.collect()} == {(d, s, READ[:d, s].sum()) for d in range(DAYS) for s in range(SENSORS) if READ[d, s]}
    near = run(spark, "[ (s,[ y | (o,y) <- W, abs(o-s) == 1 ].length) | (s,w) <- W ]")
    assert {tuple(r) for r in near.collect()} == {(s, 1 if s in (0, SENSORS - 1) else 2) for s in range(SENSORS)}
    assert run(spark, "[ s | (s,w) <- W, w > (+/[ v | (o,v) <- W ])/sensors ]").count() == (WEIGHT > WEIGHT.mean()).sum()


def test_arrays_as_values(spark):
    got = run(spark, "tensor(days)[ (d,tensor(sensors) row) | ((d,s),x) <- R, let row = (s,x), group by d ]")
    assert all(np.array_equal(r["v"], READ[r["i0"]]) for r in got.df.collect())
    got = run(spark, "tensor(2)[ (k,tensor(sensors)[ (s,w*w) | (s,w) <- W ]) | k <- 0..1 ]").df.collect()
    assert len(got) == 2 and all(np.array_equal(r["v"], WEIGHT**2) for r in got)
    flat = run(spark, "flatten([ (d,x) | ((d,s),x) <- R, group by d ])")
    assert sorted(r[1] for r in flat.collect()) == sorted(READ[READ != 0])


def test_indexes_out_of_range_and_met_twice(spark):
    got = run(spark, "tensor()(4)[ (s-2,w-1.0) | (s,w) <- W ]")
    assert {r["i0"]: r["v"] for r in got.df.collect()} == {s - 2: WEIGHT[s] - 1 for s in range(2, 6) if WEIGHT[s] != 1}
    assert np.array_equal(dense(run(spark, "tensor(3)[ (s%3,w) | (s,w) <- W ]")), [WEIGHT[k::3].max() for k in range(3)])
    assert run(spark, "tensor()(days,sensors)[ ((d,s),x) | ((d,s),x) <- R, x > 99.0 ]").df.count() == 0


def test_scalars(spark):
    assert q("7/2", spark=spark) == 3 and q("(-7)/2", spark=spark) == -3 and q("(-7)%2", spark=spark) == -1
    assert q("1.0/0.0", spark=spark) == float("inf")
    rows = q("[ (x/2,x%2,x/2.0) | x <- [7,-7] ]", spark=spark).collect()
    assert sorted(map(tuple, rows)) == [(-3, -1, -3.5), (3, 1, 3.5)]
    assert q("if (1 < 2) 5 else 6", spark=spark) == 5
    assert q("<a=1,b=2>#b", spark=spark) == 2 and q("(3,4)#1", spark=spark) == 3
    assert q("+/[1,2,3]", spark=spark) == 6 and q("[1,2,3].length", spark=spark) == 3
    assert q("def g(x: Int, y: Int): Int = x*10+y; g/[1,2,3]", spark=spark) == 123


def test_maps_records_unnest(spark):
    assert q("[ <a=x,b=y> | (x,y) <- B ]", spark=spark, B=[(1, "u"), (2, "v")]).collect() == [(1, "u"), (2, "v")]
    df = spark.createDataFrame([(1, [5, 6]), (2, [])], "i int, a array<int>")
    assert sorted(map(tuple, q("[ (i,x) | (i,a) <- D, x <- a ]", spark=spark, D=df).collect())) == [(1, 5), (1, 6)]
    assert sorted(map(tuple, q("map[ (i,v+1) | (i,v) <- B ]", spark=spark, B=[(0, 1), (1, 2)]).collect())) == [(0, 2), (1, 3)]


def test_lists_and_maps(spark):
    ask = lambda text, **n: q(text, spark=spark, **n)
    assert ask("[4,5] :+ 6") == [4, 5, 6] and ask("[4] ++ [5,6]") == [4, 5, 6] and ask("++/[[1],[2,3]]") == [1, 2, 3] and ask("flatten([[1],[2,3]])") == [1, 2, 3]
    assert ask("binarySearch(7,0,3,[2,7,9])") == 1 and ask("binarySearch(3,0,3,[2,7,9])") == -1 and ask("unique_values([3,1,3])") == [3, 1] and ask("array_size([5,5])") == 2
    assert ask("[ x | x <- [] ]").count() == 0 and ask("[ a+k | k <- 1..3, (a,b) <- [] ]").count() == 0
    assert sorted(map(tuple, ask("var m = map[ (i,i*i) | i <- 2..4 ]; [ (k,m[k+1]) | k <- 0..9 ]").collect())) == [(1, 4), (2, 9), (3, 16)]
    assert ask("var m = map[ (i,i*i) | i <- 2..4 ]; m[3]") == 9 and ask("var m = map[ (i,i*i) | i <- 2..4 ]; m[5]") is None
    assert {tuple(r) for r in ask("[ (k,M[k],L[k]) | k <- 0..2 ]", M={0: "a", 2: "c"}, L=[5, 6, 7]).collect()} == {(0, "a", 5), (1, None, 6), (2, "c", 7)}
    df = spark.createDataFrame([(1, [3, 1, 3], [1, 4, 6])], "k int, a array<int>, b array<int>")
    (r,) = ask("[ (unique_values(a),array_size(a),binarySearch(4,0,3,b),binarySearch(5,0,3,b),a :+ 9,a ++ b) | (k,a,b) <- D ]", D=df).collect()
    assert list(map(lambda x: list(x) if isinstance(x, list) else x, r)) == [[3, 1], 3, 1, -1, [3, 1, 3, 9], [3, 1, 3, 1, 4, 6]]


def test_functions(spark):
    text = "def fee(x: Double): Double = { var y = x*2; if (y > 10.0) { y = y-1.0 } else { y += 1.0 }; return y }; [ fee(x) | x <- [1.0,9.0] ]"
    assert sorted(r[0] for r in q(text, spark=spark).collect()) == [3.0, 17.0]
    assert q("var worse = (a,b) => if (a < b) a else b; worse/[4,2,8]", spark=spark) == 2
    assert sorted(map(tuple, run(spark, "var far = (a,b) => if (abs(a) > abs(b)) a else b; [ (s,abs(far/x)) | ((d,s),x) <- R, group by s ]").collect())) == sorted((s, np.abs(READ[:, s]).max()) for s in range(SENSORS) if READ[:, s].any())


def test_random_arrays_differ(spark):
    a, b = (q("tensor(50)[ (i,random()) | i <- 0..49 ]", spark=spark) for _ in range(2))
    both = q("var A = tensor(50)[ (i,random()) | i <- 0..49 ]; var B = tensor(50)[ (i,random()) | i <- 0..49 ]; [ (x,y) | (i,x) <- A, (j,y) <- B, i == j ]", spark=spark).collect()
    assert len({r[0] for r in both}) == 50 and all(r[0] != r[1] for r in both)
    assert np.array_equal(dense(a), dense(b))  # one program gives one result


def test_loops(spark):
    got = run(spark, "var best = tensor(days)[ (d,-99.0) | d <- 0..days-1 ]; for d = 0, days-1 do for s = 0, sensors-1 do best[d] = max(best[d],R[d,s]*W[s]); best;", 2)
    assert np.array_equal(dense(got), (READ * WEIGHT).max(1))
    got = run(spark, "for s = 0, sensors-1 do { if (W[s] > 0.6) W[s] = 0.0; W[s] += 2.0 }; W;")
    assert np.array_equal(dense(got), np.where(WEIGHT > 0.6, 0, WEIGHT) + 2)
    assert run(spark, "var n = 10.0; for s = 1, sensors-1, 3 do n += W[s]; n;") == 10 + WEIGHT[1::3].sum()
    assert np.array_equal(dense(run(spark, "for (s,w) in W do W[s] += w; W;")), 2 * WEIGHT)
    assert np.array_equal(dense(run(spark, "var k = 1; while (k < 9) { k = 2*k; W = [ (s,w+k) | (s,w) <- W ] }; W;")), WEIGHT + 2 + 4 + 8 + 16)


def test_assigned_from_arrays_with_gaps(spark):
    some = from_table(spark.createDataFrame([(s, 10.0 + s) for s in range(0, SENSORS, 2)], "sensor int, x double"), ["sensor"], "x", (SENSORS,), combine="sum")
    few = from_table(spark.createDataFrame([(s, 20.0 + s) for s in range(3)], "sensor int, x double"), ["sensor"], "x", (3,), dense=1, combine="sum")
    left = lambda new, stays: np.where(stays, WEIGHT, new)
    places = np.arange(SENSORS)
    got = run(spark, "for s = 0, sensors-1 do W[s] = S[s]; W;", S=some)
    assert got.df.count() == SENSORS and np.array_equal(dense(got), left(10.0 + places, places % 2 == 1))
    got = run(spark, "for s = 0, sensors-1 do W[s] = F[s]; W;", F=few)
    assert got.df.count() == SENSORS and np.array_equal(dense(got), left(20.0 + places, places > 2))
    got = run(spark, "for s = 0, sensors-1 do W[s] = 2.0-W[s]; W;")
    assert np.array_equal(dense(got), 2 - WEIGHT) and "FullOuter" not in plan(got.df)  # all there: nothing is merged


def test_components_of_elements(spark):
    text = "var T = tensor(3)[ (i,<n=0,top=0.0>) | i <- 0..2 ]; for d = 0, days-1 do for s = 0, sensors-1 do { T[s%3]#n += 1; T[s%3]#top = max(T[s%3]#top,R[d,s]) }; T;"
    with pytest.raises(LoopError):
        run(spark, "var T = tensor(3)[ (i,(0,0)) | i <- 0..2 ]; for i = 0, 2 do T[i]#3 += 1;")
    got = {r["i0"]: r["v"] for r in run(spark, text.replace(" = max(T[s%3]#top,R[d,s])", " += R[d,s]"), 2).df.collect()}
    assert {i: (v["n"], v["top"]) for i, v in got.items()} == {i: (DAYS * len(range(i, SENSORS, 3)), READ[:, i::3].sum()) for i in range(3)}
    got = run(spark, 'var T = tensor()(4)[ (i,(i,"x")) | i <- 1..2 ]; for i = 2, 3 do T[i]#1 += 40; T;').df.collect()
    assert {r["i0"]: tuple(r["v"]) for r in got} == {1: (1, "x"), 2: (42, "x"), 3: (40, None)}


def test_loops_without_a_bulk_form(spark):
    for text in ("for s = 1, sensors-1 do W[s] = W[s-1];", "for s = 0, 3 do for k = 0, 2 do W[s*k] += 1.0;"):
        with pytest.raises(LoopError):
            run(spark, text)
    with pytest.raises(LoweringError):
        run(spark, "[ unknown | (s,w) <- W ]")


def test_trace_and_plan(spark, capsys):
    from quillgrid import config, explain, param

    param("trace", True)
    try:
        got = run(spark, "[ (d,+/x) | ((d,s),x) <- R, x > 1.0, group by d ]")
    finally:
        param("trace", False)
    assert "group by d" in capsys.readouterr().out and not config.trace
    explain(got)
    assert "Physical Plan" in capsys.readouterr().out


def test_text_sources(spark, tmp_path):
    from quillgrid.sources import coordinates, edges

    (tmp_path / "e.txt").write_text("1 2\n2 3\n")
    (tmp_path / "c.csv").write_text("0,1,2.5\n1,0,-1\n7,7,1\n")
    assert sorted(map(tuple, edges(spark, str(tmp_path / "e.txt"), " ").collect())) == [(1, 2), (2, 3)]
    assert dense(coordinates(spark, str(tmp_path / "c.csv"), (2, 2))).tolist() == [[0, 2.5], [-1, 0]]


def test_match_and_lambda(spark):
    got = q("[ (x, x match { case y if y > 1 => 10 case _ => 0 }) | x <- [1,2] ]", spark=spark)
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 10)]
    assert q("var g = (x,y) => x*y; g(6,7)", spark=spark) == 42


def test_declared_storage(spark):
    """A storage declared in the program: a vector kept with its places reversed."""
    got = q(
        """typemap turned[T](n: Int): array1[T] {
             def view(x: list[(Int,T)]) = [ (n-1-i,v) | (i,v) <- x ]
             def store(x: list[(Int,T)]) = [ (n-1-i,v) | (i,v) <- x ]
           }
           var W = turned(4)[ (i,i*10) | i <- 0..3 ];
           [ (i,v) | (i,v) <- W ];""",
        spark=spark,
    )
    assert sorted(map(tuple, got.collect())) == [(i, i * 10) for i in range(4)]


def test_registered_storage(spark):
    from quillgrid import register_storage

    register_storage("doubled", lambda df: df.selectExpr("a as _1", "b div 2 as _2"), lambda df: df.selectExpr("_1 as a", "_2 * 2 as b"))
    kept = q("doubled()[ (i,i+1) | i <- 0..2 ]", spark=spark)
    assert sorted(map(tuple, kept.table.collect())) == [(0, 2), (1, 4), (2, 6)]
    assert sorted(map(tuple, q("[ (i,v) | (i,v) <- W ]", spark=spark, W=kept).collect())) == [(0, 1), (1, 2), (2, 3)]


def test_array_of_rows_and_map_reads(spark):
    df = spark.createDataFrame([(0, [4, 5]), (1, [6, 7])], "i int, a array<int>")
    assert sorted(map(tuple, q("[ (i,a[1],a.length,+/a) | (i,a) <- D ]", spark=spark, D=df).collect())) == [(0, 5, 2, 9), (1, 7, 2, 13)]
    assert sorted(map(tuple, q("[ (i,+/[ x*2 | x <- a, x > 4 ]) | (i,a) <- D ]", spark=spark, D=df).collect())) == [(0, 10), (1, 26)]
