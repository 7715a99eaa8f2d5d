"""One query for each operator of the engine, on the driver's tables, with its SQL.

Arrays: QTY = supplier x part -> total quantity (sparse), ORD = customer -> total
of orders in cents (sparse), ACCT = customer -> balance in cents (dense),
EVT = user x hour -> number of events (sparse), EMB = vector x dimension (dense),
G = edges from customers to suppliers, of which a node may be both. Values are whole numbers where sums are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import q
from ..sources import from_table, table, vectors
from ..tensor import Tensor
from . import algorithms, blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_QTY = "qty AS (SELECT CAST(l_suppkey AS BIGINT) i, CAST(l_partkey AS BIGINT) j, sum(l_quantity) v FROM lineitem GROUP BY 1, 2)"
_ORD = "ord AS (SELECT CAST(o_custkey AS BIGINT) i, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) v FROM orders GROUP BY 1)"
_ACCT = "acct AS (SELECT CAST(c_custkey AS BIGINT) i, CAST(round(c_acctbal * 100) AS BIGINT) v FROM customer)"
_EVT = "evt AS (SELECT CAST(user_id AS BIGINT) i, CAST(hour(ts) AS BIGINT) j, count(*) v FROM events GROUP BY 1, 2)"
_G = "g AS (SELECT DISTINCT o_custkey src, l_suppkey dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 48)"
_GRID = "grid AS (SELECT u.i, h.j FROM (SELECT range AS i FROM range(0, (SELECT max(user_id) + 1 FROM events))) u, (SELECT range AS j FROM range(0, 24)) h)"


def _whole(df: DataFrame, key: str, column: str | None = None, size: int = 0) -> tuple[int, bool]:
    """The length of an array of a table's rows, and whether it has one row (with ``size`` values) for every index."""
    fits = F.bool_and(F.col(key).isNotNull() & (F.col(key) >= 0) & (F.size(column) == size if column else F.lit(True)))
    n, rows, keys, good = df.agg(F.coalesce(F.max(key), F.lit(-1)) + 1, F.count(F.lit(1)), F.count_distinct(key), fits).first()
    return n, bool(good) and n == rows == keys


def _size(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def qty(spark: SparkSession, d: str) -> Tensor:
    df = table(spark, d, "lineitem")
    n, m = df.agg(F.max("l_suppkey") + 1, F.max("l_partkey") + 1).first()
    return from_table(df, ["l_suppkey", "l_partkey"], "l_quantity", (n, m), combine="sum")


def ord_(spark: SparkSession, d: str) -> Tensor:
    return from_table(table(spark, d, "orders"), ["o_custkey"], F.round(F.col("o_totalprice") * 100).cast("bigint"), (_size(table(spark, d, "customer"), "c_custkey"),), combine="sum")


def acct(spark: SparkSession, d: str) -> Tensor:
    df = table(spark, d, "customer")
    n, whole = _whole(df, "c_custkey")
    t = from_table(df, ["c_custkey"], F.round(F.col("c_acctbal") * 100).cast("bigint"), (n,), dense=1, combine=None if whole else "max", unique=whole)
    return t.with_df(t.df, whole)


def evt(spark: SparkSession, d: str) -> Tensor:
    df = table(spark, d, "events")
    return from_table(df.withColumn("h", F.hour("ts")), ["user_id", "h"], F.lit(1), (_size(df, "user_id"), 24), combine="count")


def emb(spark: SparkSession, d: str) -> Tensor:
    df = table(spark, d, "embeddings")
    n, whole = _whole(df, "vec_id", "embedding", 64)
    return vectors(df, "vec_id", "embedding", (n, 64), full=whole)


def graph(spark: SparkSession, d: str) -> DataFrame:
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_quantity >= 48")
    return o.join(line, o["o_orderkey"] == line["l_orderkey"]).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def nodes(spark: SparkSession, d: str) -> int:
    return max(_size(table(spark, d, "customer"), "c_custkey"), _size(table(spark, d, "supplier"), "s_suppkey"))


def _rows(t: Tensor, *names: str) -> DataFrame:
    return t.df.toDF(*(names or [*"ijk"[: t.rank], "v"]))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- products


@query(f"WITH {_QTY} SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM qty x JOIN qty y ON x.j = y.j GROUP BY 1, 2")
def sparse_matmul(spark, d):
    a = qty(spark, d)
    return _rows(q("tensor*()(S,S)[ ((i,j),+/v) | ((i,k),a) <- QTY, ((j,kk),b) <- QTY, kk == k, let v = a*b, group by (i,j) ]", QTY=a, S=a.dims[0], spark=spark))


@query(f"WITH {_QTY} SELECT x.i, y.i AS j, min(x.v + y.v) AS v FROM qty x JOIN qty y ON x.j = y.j GROUP BY 1, 2")
def minplus_matmul(spark, d):
    a = qty(spark, d)
    t = q("tensor*()(P,S)[ ((j,i),v) | ((i,j),v) <- QTY ]", QTY=a, P=a.dims[1], S=a.dims[0], spark=spark)
    return _rows(algorithms.tropical(a, t, spark=spark))


@query(
    f"WITH {_EVT}, g AS (SELECT x.j, y.j AS l, sum(x.v * y.v) v FROM evt x JOIN evt y ON x.i = y.i GROUP BY 1, 2) "
    "SELECT e.i, g.l AS j, CAST(sum(e.v * g.v) AS BIGINT) AS v FROM evt e JOIN g ON e.j = g.j GROUP BY 1, 2"
)
def chain_matmul(spark, d):
    """E (Et E): the chain is bracketed so that what is in between is as small as the hours."""
    e = evt(spark, d)
    return _rows(
        q(
            """var G = tensor*()(24,24)[ ((j,l),+/v) | ((i,j),a) <- E, ((ii,l),b) <- E, ii == i, let v = a*b, group by (j,l) ];
               tensor*()(n,24)[ ((i,l),+/v) | ((i,j),a) <- E, ((jj,l),g) <- G, jj == j, let v = a*g, group by (i,l) ];""",
            E=e,
            n=e.dims[0],
            spark=spark,
        )
    )


@query(
    "WITH e AS (SELECT vec_id i, generate_subscripts(embedding, 1) - 1 k, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings) "
    "SELECT CAST(x.i AS BIGINT) AS i, CAST(y.i AS BIGINT) AS j, round(sum(x.v * y.v), 6) + 0.0 AS v FROM e x JOIN e y ON x.k = y.k GROUP BY 1, 2"
)
def dense_gram(spark, d):
    """The product of all vectors with their transpose, block by block."""
    e = emb(spark, d)
    c = q("tensor*(n,n)[ ((i,j),+/p) | ((i,k),a) <- E, ((j,kk),b) <- E, kk == k, let p = a*b, group by (i,j) ]", E=e, n=e.dims[0], spark=spark)
    return c.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


# ---------------------------------------------------------------- maps, scans, stores


@query(f"WITH {_ACCT} SELECT i, v + 1 AS v FROM acct")
def dense_scan_map(spark, d):
    a = acct(spark, d)
    return _rows(q("tensor*(n)[ (i,v+1) | (i,v) <- A ]", A=a, n=a.dims[0], spark=spark))


@query(f"WITH {_QTY} SELECT x.i, x.j, x.v + y.v AS v FROM qty x JOIN qty y ON x.i = y.i AND x.j = y.j + 1")
def sparse_add_inner(spark, d):
    a = qty(spark, d)
    return _rows(q("tensor*()(n,m)[ ((i,j),a+b) | ((i,j),a) <- A, ((ii,jj),b) <- A, ii == i, jj+1 == j ]", A=a, n=a.dims[0], m=a.dims[1], spark=spark))


@query(
    f"WITH {_EVT}, {_GRID}, s AS (SELECT grid.i, grid.j, coalesce(x.v, 0) + coalesce(y.v, 0) v FROM grid "
    "LEFT JOIN evt x ON x.i = grid.i AND x.j = grid.j LEFT JOIN evt y ON y.i = grid.i AND y.j = 23 - grid.j) SELECT i, j, CAST(v AS BIGINT) AS v FROM s WHERE v <> 0"
)
def sparse_add_full(spark, d):
    e = evt(spark, d)
    return _rows(
        q(
            """var B = tensor*()(n,24)[ ((i,23-j),v) | ((i,j),v) <- E ];
               tensor*()(n,24)[ ((i,j),a+b) | ((i,j),a) <= E, ((ii,jj),b) <= B, ii == i, jj == j ];""",
            E=e,
            n=e.dims[0],
            spark=spark,
        )
    )


@query(f"WITH {_EVT}, {_GRID} SELECT grid.i, grid.j, CAST(coalesce(v, 0) AS BIGINT) AS v FROM grid LEFT JOIN evt ON evt.i = grid.i AND evt.j = grid.j")
def full_scan_grid(spark, d):
    e = evt(spark, d)
    return _rows(q("tensor*(n,24)[ ((i,j),v) | ((i,j),v) <= E ]", E=e, n=e.dims[0], spark=spark))


@query(f"WITH {_ACCT}, {_ORD} SELECT a.i, a.v + o.v + b.v AS v FROM acct a JOIN ord o ON a.i = o.i JOIN acct b ON b.i = o.i")
def three_way_add(spark, d):
    a, o = acct(spark, d), ord_(spark, d)
    return _rows(q("tensor*(n)[ (i,x+y+z) | (i,x) <- A, (ii,y) <- O, (iii,z) <- A, ii == i, iii == ii ]", A=a, O=o, n=a.dims[0], spark=spark))


@query(f"WITH {_QTY} SELECT j AS i, i AS j, v FROM qty")
def transpose(spark, d):
    a = qty(spark, d)
    return _rows(q("tensor*()(m,n)[ ((j,i),v) | ((i,j),v) <- A ]", A=a, n=a.dims[0], m=a.dims[1], spark=spark))


@query(f"WITH {_ACCT} SELECT (i + 1) % (SELECT max(c_custkey) + 1 FROM customer) AS i, v + 1 AS v FROM acct")
def index_rotate(spark, d):
    a = acct(spark, d)
    return _rows(q("tensor*(N)[ ((i+1)%N,v+1) | (i,v) <- A ]", A=a, N=a.dims[0], spark=spark))


@query(f"WITH {_EVT} SELECT i, j, (i + j) % 10 AS k, v + 1 AS v FROM evt")
def rank_change(spark, d):
    e = evt(spark, d)
    return _rows(q("tensor*(n,24)(10)[ ((i,j,(i+j)%10),v+1) | ((i,j),v) <- E ]", E=e, n=e.dims[0], spark=spark))


@query(f"WITH {_QTY} SELECT i, j, true AS v FROM qty WHERE v < 40")
def mask_bool(spark, d):
    a = qty(spark, d)
    return _rows(q("tensor*(n)(m)[ ((i,j),v<40) | ((i,j),v) <- A ]", A=a, n=a.dims[0], m=a.dims[1], spark=spark))


@query(f"WITH {_QTY} SELECT i, CAST(count(*) AS BIGINT) AS v FROM qty WHERE v < 40 GROUP BY 1")
def mask_predicate(spark, d):
    """Elements of a boolean array as predicates, in a loop."""
    a = qty(spark, d)
    return _rows(
        q(
            """var B = tensor*(n)(m)[ ((i,j),v<40) | ((i,j),v) <- A ];
               var C = tensor*()(n)[ (i,0L) | i <- 0..n-1 ];
               for i = 0, n-1 do for j = 0, m-1 do if (B[i,j]) C[i] += 1L;
               C;""",
            A=a,
            n=a.dims[0],
            m=a.dims[1],
            spark=spark,
        )
    )


@query(
    f"WITH {_EVT}, {_GRID}, dense AS (SELECT grid.i, grid.j, coalesce(v, 0) v FROM grid LEFT JOIN evt ON evt.i = grid.i AND evt.j = grid.j), "
    "o(a, b) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) SELECT d.i + o.a AS i, d.j + o.b AS j, CAST(sum(d.v) AS DOUBLE) / count(*) AS v "
    "FROM dense d, o WHERE d.i + o.a BETWEEN 0 AND (SELECT max(user_id) FROM events) AND d.j + o.b BETWEEN 0 AND 23 GROUP BY 1, 2"
)
def stencil_mean(spark, d):
    """Each cell's mean with its four neighbours: a cell is sent to the five places that it counts for."""
    e = evt(spark, d)
    cross = spark.createDataFrame([(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)], "a long, b long")
    return _rows(
        q("tensor*(n,24)[ (at,(+/w)/w.length) | ((user,hour),c) <= E, (a,b) <- cross, let w = c.toDouble, group by at: (user+a,hour+b) ]", E=e, cross=cross, n=e.dims[0], spark=spark)
    )


# ---------------------------------------------------------------- aggregation


@query(f"WITH {_QTY} SELECT i, sum(v) AS v FROM qty GROUP BY 1")
def row_sum(spark, d):
    a = qty(spark, d)
    return _rows(q("tensor*()(n)[ (i,+/v) | ((i,j),v) <- A, group by i ]", A=a, n=a.dims[0], spark=spark))


@query(f"WITH {_QTY} SELECT j AS i, sum(v) / count(*) AS v FROM qty GROUP BY 1")
def col_mean(spark, d):
    a = qty(spark, d)
    return _rows(q("tensor*()(m)[ (j,(+/v)/v.length) | ((i,j),v) <- A, group by j ]", A=a, m=a.dims[1], spark=spark))


@query(f"WITH {_QTY} SELECT i, count(*) AS n, min(v) AS low, max(v) AS high FROM qty GROUP BY 1")
def row_minmax(spark, d):
    return q("[ <i=i,n=v.length,low=min/v,high=max/v> | ((i,j),v) <- A, group by i ]", A=qty(spark, d), spark=spark)


@query("SELECT l_orderkey AS i, CAST(product(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def row_product(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return q("[ <i=o,v=* /n> | (o,n) <- L, group by o ]", L=line, spark=spark)


@query(f"WITH {_QTY} SELECT i, bool_and(v > 10) AS a, bool_or(v > 90) AS b FROM qty GROUP BY 1")
def bool_all_any(spark, d):
    return q("[ <i=i,a=&&/x,b=||/y> | ((i,j),v) <- A, let x = v > 10, let y = v > 90, group by i ]", A=qty(spark, d), spark=spark)


@query(f"WITH {_QTY} SELECT sum(v) AS v FROM qty WHERE v > 20")
def total_agg(spark, d):
    return q("[ +/v | ((i,j),v) <- A, v > 20, let k = 1, group by k ]", A=qty(spark, d), spark=spark).toDF("v")


@query(f"WITH {_EVT} SELECT i + j AS k, sum(v) / count(*) AS v FROM (SELECT i, j, CAST(v AS DOUBLE) v FROM evt) WHERE v > 1 GROUP BY 1 HAVING sum(v) > 10")
def diagonal_having(spark, d):
    return q("[ <k=k,v=(+/w)/w.length> | ((i,j),v) <- E, v > 1, let w = v.toDouble, group by k: i+j, +/w > 10 ]", E=evt(spark, d), spark=spark)


@query(f"WITH {_QTY} SELECT i % 10 AS a, j % 20 AS b, sum(v) AS v, count(*) AS n FROM qty GROUP BY 1, 2")
def group_computed_key(spark, d):
    return q("[ <a=a,b=b,v=+/v,n=v.length> | ((i,j),v) <- A, group by (a,b): (i%10,j%20) ]", A=qty(spark, d), spark=spark)


@query(f"WITH {_QTY} SELECT i, j, v, CAST(1 AS BIGINT) AS n FROM qty")
def group_unique_key(spark, d):
    """Groups of one element: no aggregation and no shuffle."""
    return q("[ <i=i,j=j,v=+/v,n=v.length> | ((i,j),v) <- A, group by (i,j) ]", A=qty(spark, d), spark=spark)


@query("SELECT user_id AS i, CAST(count(*) AS BIGINT) AS n, sum(CASE WHEN value > 50 THEN CAST(floor(value) AS BIGINT) ELSE 0 END)::BIGINT AS v FROM events GROUP BY 1")
def mapped_bag(spark, d):
    """A reduction of a mapped and filtered bag."""
    bag = table(spark, d, "events").select("user_id", "value")
    return q("[ <i=u,n=x.length,v=+/[ floor(y) | y <- x, y > 50.0 ]> | (u,x) <- B, group by u ]", B=bag, spark=spark)


@query(f"WITH {_EVT} SELECT i, list_sort(list(j)) AS hours, sum(v)::BIGINT AS v FROM evt GROUP BY 1")
def nested_collect(spark, d):
    return q("[ <i=i,hours=sort(j),v=+/v> | ((i,j),v) <- E, group by i ]", E=evt(spark, d), spark=spark)


@query(
    f"WITH {_EVT} SELECT e.i, list(coalesce(x.v, 0)::BIGINT ORDER BY h.j) AS late FROM (SELECT DISTINCT i FROM evt WHERE j >= 12) e CROSS JOIN (SELECT range AS j FROM range(12, 24)) h "
    "LEFT JOIN evt x ON x.i = e.i AND x.j = h.j GROUP BY 1"
)
def nested_tensor(spark, d):
    """Arrays as elements: the afternoon's hours of each user as a dense vector."""
    return q("[ <i=user,late=tensor(12) cells> | ((user,hour),c) <- E, hour >= 12, let cells = (hour-12,c), group by user ]", E=evt(spark, d), spark=spark)


@query(f"WITH {_EVT} SELECT i, CAST(min(least(v, 7)) AS BIGINT) AS v FROM evt GROUP BY 1")
def user_monoid(spark, d):
    """A reduction by a function of the surroundings."""
    return q("def lower(x: Long, y: Long): Long = min(x,y); [ <i=i,v=lower/w> | ((i,j),v) <- E, let w = min(v,7L), group by i ]", E=evt(spark, d), spark=spark)


# ---------------------------------------------------------------- joins and subqueries


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey")
def cross_theta_join(spark, d):
    n, r = table(spark, d, "nation").select("n_name", "n_regionkey"), table(spark, d, "region").select("r_regionkey", "r_name")
    return q("[ <n_name=a,r_name=b> | (a,x) <- N, (y,b) <- R, x < y ]", N=n, R=r, spark=spark)


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k, unnest(embedding) AS v FROM embeddings")
def dependent_unnest(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x, k: F.struct(k.alias("k"), x.alias("v"))).alias("cells"))
    return q("[ <vec_id=i,k=k,v=v> | (i,a) <- E, (k,v) <- a ]", E=e, spark=spark)


@query(f"WITH {_ACCT}, {_ORD} SELECT acct.i, acct.v + ord.v AS v FROM acct JOIN ord ON acct.i = ord.i")
def index_access_join(spark, d):
    a, o = acct(spark, d), ord_(spark, d)
    return q("[ <i=i,v=v+O[i]> | (i,v) <- A ]", A=a, O=o, spark=spark)


@query(f"WITH {_ACCT} SELECT i, v FROM acct WHERE v > (SELECT avg(v) FROM acct)")
def scalar_subquery(spark, d):
    return q("[ <i=i,v=v> | (i,v) <- A, v.toDouble > (+/[ w.toDouble | (ii,w) <- A ])/n ]", A=(a := acct(spark, d)), n=a.dims[0], spark=spark)


@query(f"WITH {_QTY} SELECT i, j, v FROM qty x WHERE v * 300 > (SELECT sum(y.v) FROM qty y WHERE y.i = x.i)")
def correlated_subquery(spark, d):
    return q("[ <i=i,j=j,v=v> | ((i,j),v) <- A, v*300 > (+/[ w | ((ii,jj),w) <- A, ii == i ]) ]", A=qty(spark, d), spark=spark)


@query(f"WITH {_ORD} SELECT i AS k, v + 1 AS v FROM ord")
def map_build(spark, d):
    return q("map[ (i,v+1) | (i,v) <- O ]", O=ord_(spark, d), spark=spark)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS level FROM orders")
def match_cases(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return q('[ <o_orderkey=k,level=p match { case x if x > 200000.0 => "high" case x if x > 100000.0 => "middle" case _ => "low" }> | (k,p) <- O ]', O=o, spark=spark)


# ---------------------------------------------------------------- loops


@query(f"WITH {_ACCT}, {_ORD} SELECT acct.i, acct.v + coalesce(ord.v, 0) AS v FROM acct LEFT JOIN ord ON acct.i = ord.i")
def array_increment(spark, d):
    a, o = acct(spark, d), ord_(spark, d)
    return _rows(q("for i = 0, n-1 do A[i] += O[i]; A;", A=a, O=o, n=a.dims[0], spark=spark))


@query(f"WITH {_ACCT}, {_ORD} SELECT acct.i, coalesce(ord.v, acct.v) AS v FROM acct LEFT JOIN ord ON acct.i = ord.i")
def array_update(spark, d):
    a, o = acct(spark, d), ord_(spark, d)
    return _rows(q("for i = 0, n-1 do A[i] = O[i]; A;", A=a, O=o, n=a.dims[0], spark=spark))


@query(f"WITH {_QTY} SELECT i, sum(v) AS v FROM qty GROUP BY 1")
def loop_row_sum(spark, d):
    a = qty(spark, d)
    return _rows(
        q(
            "var V = tensor*()(n)[ (i,0.0) | i <- 0..n-1 ]; for i = 0, n-1 do for j = 0, m-1 do V[i] += A[i,j]; V;",
            A=a,
            n=a.dims[0],
            m=a.dims[1],
            spark=spark,
        )
    )


@query(f"WITH {_QTY} SELECT sum(v) AS v FROM qty WHERE i % 2 = 0")
def scalar_increment(spark, d):
    a = qty(spark, d)
    total = q("var s = 0.0; for i = 0, n-1, 2 do for j = 0, m-1 do s += A[i,j]; s;", A=a, n=a.dims[0], m=a.dims[1], spark=spark)
    return spark.range(1).select(F.lit(total).alias("v"))


@query(f"WITH {_G} SELECT CAST(src AS BIGINT) AS i, count(*) AS v FROM g GROUP BY 1")
def out_degree(spark, d):
    return _rows(q("tensor*()(n)[ (i,j.length) | (i,j) <- G, group by i ]", G=graph(spark, d), n=nodes(spark, d), spark=spark))


@query(f"WITH {_G} SELECT CAST(src AS BIGINT) AS i, list_sort(list(CAST(dst AS BIGINT))) AS v FROM g GROUP BY 1")
def adjacency(spark, d):
    """Each node's neighbours as a bag value."""
    return q("[ <i=i,v=sort(j)> | (i,j) <- G, group by i ]", G=graph(spark, d), spark=spark)


_N = "nn AS (SELECT greatest((SELECT max(c_custkey) FROM customer), (SELECT max(s_suppkey) FROM supplier)) + 1 AS n), nodes AS (SELECT unnest(range(0, (SELECT n FROM nn))) AS i)"
_PR = ["p0 AS (SELECT i, 1.0::DOUBLE / (SELECT n FROM nn) AS v FROM nodes)"] + [
    f"p{k} AS (SELECT n.i, 0.15::DOUBLE / (SELECT n FROM nn) + 0.85 * coalesce(s.v, 0) AS v FROM nodes n LEFT JOIN (SELECT e.dst AS i, sum(e.w * p.v) v FROM e JOIN p{k - 1} p ON p.i = e.src GROUP BY 1) s ON s.i = n.i)"
    for k in (1, 2, 3)
]
_RANKS = f"WITH {_G}, {_N}, c AS (SELECT src, count(*) n FROM g GROUP BY 1), e AS (SELECT g.src, g.dst, 1.0::DOUBLE / n AS w FROM g JOIN c ON c.src = g.src), {', '.join(_PR)} SELECT i, round(v, 12) AS v FROM p3"


@query(_RANKS)
def pagerank_3(spark, d):
    p = algorithms.pagerank(graph(spark, d), nodes(spark, d), rounds=3, spark=spark)
    return p.df.select(F.col("i0").alias("i"), F.round("v", 12).alias("v"))


@query(_RANKS)
def pagerank_lists(spark, d):
    p = algorithms.pagerank_of_lists(graph(spark, d), nodes(spark, d), rounds=3, spark=spark)
    return p.df.select(F.col("i0").alias("i"), F.round("v", 12).alias("v"))


_XY = (
    "e AS (SELECT vec_id i, generate_subscripts(embedding, 1) j, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings), "
    "x AS (SELECT i, j, v FROM e UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings), y AS (SELECT vec_id i, CAST(label % 2 AS DOUBLE) v FROM embeddings)"
)


def _features(spark, d):
    """All dimensions of the vectors behind a constant, and the labels, as matrices."""
    df = table(spark, d, "embeddings")
    n, whole = _whole(df, "vec_id", "embedding", 64)
    x = df.select("vec_id", F.concat(F.array(F.lit(1.0)), F.col("embedding").cast("array<double>")).alias("x"))
    return vectors(x, "vec_id", "x", (n, 65), full=whole), vectors(df.select("vec_id", F.array((F.col("label") % 2).cast("double")).alias("y")), "vec_id", "y", (n, 1), full=whole)


def _weights(spark, n, m):
    return q("tensor*(n,m)[ ((i,j),((i*7+j*3)%10)/10.0-0.5) | i <- 0..n-1, j <- 0..m-1 ]", n=n, m=m, spark=spark)


@query(
    f"WITH {_XY}, h AS (SELECT i, sum(v * (j * 3 % 10) / 10.0) v FROM x GROUP BY 1), r AS (SELECT h.i, h.v - y.v v FROM h JOIN y ON y.i = h.i) "
    "SELECT CAST(x.j AS BIGINT) AS i, round((x.j * 3 % 10) / 10.0 - 0.1 * sum(x.v * r.v) / (SELECT count(*) FROM embeddings), 9) AS v FROM x JOIN r ON r.i = x.i GROUP BY x.j"
)
def linreg_step(spark, d):
    x, y = _features(spark, d)
    theta = q("tensor*(65,1)[ ((j,k),((j*3)%10)/10.0) | j <- 0..64, k <- 0..0 ]", spark=spark)
    t = algorithms.regression_step(x, y, theta, rate=0.1, spark=spark)
    return t.df.select(F.col("i0").alias("i"), F.round("v", 9).alias("v"))


_W = "w{k} AS (SELECT a.range i, b.range j, ((a.range * 7 + b.range * 3) % 10) / 10.0 - 0.5 v FROM range(0, {n}) a, range(0, {m}) b)"


@query(
    f"WITH {_XY}, {_W.format(k=1, n=65, m=4)}, {_W.format(k=2, n=4, m=1)}, "
    "h AS (SELECT x.i, w1.j, greatest(sum(x.v * w1.v), 0.0) v FROM x JOIN w1 ON w1.i = x.j GROUP BY 1, 2) "
    "SELECT CAST(h.i AS BIGINT) AS i, round(1.0 / (1.0 + exp(-sum(h.v * w2.v))), 9) AS v FROM h JOIN w2 ON w2.i = h.j GROUP BY 1"
)
def nn_forward(spark, d):
    x, _ = _features(spark, d)
    out = algorithms.forward(x, [_weights(spark, 65, 4), _weights(spark, 4, 1)], spark=spark)
    return out.df.select(F.col("i0").alias("i"), F.round("v", 9).alias("v"))


@query(
    f"WITH {_XY}, {_W.format(k=1, n=65, m=4)}, {_W.format(k=2, n=4, m=3)}, {_W.format(k=3, n=3, m=1)}, "
    "h1 AS (SELECT x.i, w1.j, greatest(sum(x.v * w1.v), 0.0) v FROM x JOIN w1 ON w1.i = x.j GROUP BY 1, 2), "
    "h2 AS (SELECT h1.i, w2.j, greatest(sum(h1.v * w2.v), 0.0) v FROM h1 JOIN w2 ON w2.i = h1.j GROUP BY 1, 2), "
    "e3 AS (SELECT h2.i, 1.0 / (1.0 + exp(-sum(h2.v * w3.v))) - any_value(y.v) v FROM h2 JOIN w3 ON w3.i = h2.j JOIN y ON y.i = h2.i GROUP BY 1), "
    "e2 AS (SELECT h2.i, h2.j, CASE WHEN h2.v > 0 THEN e3.v * w3.v ELSE 0 END v FROM h2 JOIN e3 ON e3.i = h2.i JOIN w3 ON w3.i = h2.j), "
    "b1 AS (SELECT e2.i, w2.i j, sum(e2.v * w2.v) v FROM e2 JOIN w2 ON w2.j = e2.j GROUP BY 1, 2), "
    "e1 AS (SELECT b1.i, b1.j, CASE WHEN h1.v > 0 THEN b1.v ELSE 0 END v FROM b1 JOIN h1 ON h1.i = b1.i AND h1.j = b1.j), "
    "g AS (SELECT 1 layer, x.j i, e1.j, sum(x.v * e1.v) v FROM x JOIN e1 ON e1.i = x.i GROUP BY ALL "
    "UNION ALL SELECT 2, h1.j, e2.j, sum(h1.v * e2.v) FROM h1 JOIN e2 ON e2.i = h1.i GROUP BY ALL UNION ALL SELECT 3, h2.j, 0, sum(h2.v * e3.v) FROM h2 JOIN e3 ON e3.i = h2.i GROUP BY ALL), "
    "w AS (SELECT 1 layer, * FROM w1 UNION ALL SELECT 2, * FROM w2 UNION ALL SELECT 3, * FROM w3) "
    "SELECT w.layer, CAST(w.i AS BIGINT) AS i, CAST(w.j AS BIGINT) AS j, round(w.v - 0.1 * g.v / (SELECT count(*) FROM embeddings), 9) + 0.0 AS v FROM w JOIN g ON g.layer = w.layer AND g.i = w.i AND g.j = w.j"
)
def nn_train_step(spark, d):
    """Forward and backward through three layers: the weights after one step."""
    x, y = _features(spark, d)
    new = algorithms.train_step(x, y, [_weights(spark, 65, 4), _weights(spark, 4, 3), _weights(spark, 3, 1)], rate=0.1, spark=spark)
    parts = [w.df.select(F.lit(k + 1).alias("layer"), F.col("i0").alias("i"), F.col("i1").alias("j"), (F.round("v", 9) + F.lit(0.0)).alias("v")) for k, w in enumerate(new)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_FACTORS = (
    f"WITH {_EVT}, r AS (SELECT i, j, CAST(v AS DOUBLE) v FROM evt), k AS (SELECT range k FROM range(0, 3)), u AS (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) i), "
    "p AS (SELECT u.i, k, ((u.i * 7 + k * 3) % 10) / 10.0 v FROM u, k), f AS (SELECT k, b.range j, ((k * 7 + b.range * 3) % 10) / 10.0 v FROM range(0, 24) b, k), "
    "pq AS (SELECT p.i, f.j, sum(p.v * f.v) v FROM p JOIN f ON p.k = f.k GROUP BY 1, 2), e AS (SELECT r.i, r.j, r.v - pq.v v FROM r JOIN pq ON pq.i = r.i AND pq.j = r.j), "
    "gp AS (SELECT e.i, f.k, sum(e.v * f.v) v FROM e JOIN f ON f.j = e.j GROUP BY 1, 2), gf AS (SELECT p.k, e.j, sum(e.v * p.v) v FROM e JOIN p ON p.i = e.i GROUP BY 1, 2) "
    "SELECT 'P' AS factor, CAST(p.i AS BIGINT) AS i, CAST(p.k AS BIGINT) AS j, round(p.v + 0.002 * (2 * coalesce(gp.v, 0) - 0.02 * p.v), 9) AS v FROM p LEFT JOIN gp ON gp.i = p.i AND gp.k = p.k "
    "UNION ALL SELECT 'F', CAST(f.k AS BIGINT), CAST(f.j AS BIGINT), round(f.v + 0.002 * (2 * coalesce(gf.v, 0) - 0.02 * f.v), 9) FROM f LEFT JOIN gf ON gf.k = f.k AND gf.j = f.j"
)


def _factored(spark, d, algorithm):
    e = evt(spark, d)
    n = e.dims[0]
    r = q("tensor*()(n,24)[ ((i,j),v.toDouble) | ((i,j),v) <- E ]", E=e, n=n, spark=spark)
    p = q("tensor*(n,3)[ ((i,j),((i*7+j*3)%10)/10.0) | i <- 0..n-1, j <- 0..2 ]", n=n, spark=spark)
    f = q("tensor*(3,24)[ ((i,j),((i*7+j*3)%10)/10.0) | i <- 0..2, j <- 0..23 ]", spark=spark)
    both = [t.df.select(F.lit(name).alias("factor"), F.col("i0").alias("i"), F.col("i1").alias("j"), F.round("v", 9).alias("v")) for name, t in zip("PF", algorithm(r, p, f, spark=spark), strict=True)]
    return both[0].unionAll(both[1])


@query(_FACTORS)
def factor_step(spark, d):
    """Both factors after one gradient step."""
    return _factored(spark, d, algorithms.factorize_step)


@query(_FACTORS)
def factor_loops(spark, d):
    """The same step written as loops."""
    return _factored(spark, d, algorithms.factorize_in_loops)
