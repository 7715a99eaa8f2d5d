"""Queries of the language's smaller pieces, each with its SQL, beside those of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..api import q
from ..plans.program import register_storage
from ..session import shared_folder
from ..sources import edges, table
from .catalog import _ACCT, _EVT, _GRID, _ORD, _QTY, _rows, acct, emb, evt, ord_, qty, query

# ---------------------------------------------------------------- sources


@query("SELECT n_nationkey AS k, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE NULL END AS side, [10, 20, 30][n_regionkey + 1] AS code FROM nation")
def local_lookups(spark, d):
    """A local map and a local list, read by a row's key."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return q("[ <k=k,side=M[r],code=L[r]> | (k,r) <- N ]", N=n, M={0: "south", 1: "west"}, L=[10, 20, 30], spark=spark)


@query(f"WITH {_EVT} SELECT evt.i, sum(evt.v * w.w)::BIGINT AS v FROM evt JOIN (VALUES (9, 2), (12, 3), (17, 5)) w(h, w) ON w.h = evt.j GROUP BY 1")
def local_list_join(spark, d):
    """A list literal beside a sparse matrix: the list is the side that every task gets."""
    return q("[ <i=user,v=+/p> | ((user,hour),c) <- E, (h,w) <- [(9,2),(12,3),(17,5)], h == hour, let p = c*w, group by user ]", E=evt(spark, d), spark=spark)


@query("SELECT r_regionkey AS k FROM region WHERE false")
def empty_list(spark, d):
    return q("[ <k=k> | (k,name) <- R, x <- [] ]", R=table(spark, d, "region").select("r_regionkey", "r_name"), spark=spark)


@query(f"WITH {_ORD}, {_ACCT} SELECT acct.i, acct.v + ord.v * 2 AS v FROM acct JOIN ord ON ord.i = acct.i")
def map_reads(spark, d):
    """A distributed map, built by the program and read by key."""
    return q("var total = map[ (i,v*2) | (i,v) <- O ]; [ <i=i,v=v+total[i]> | (i,v) <- A ]", O=ord_(spark, d), A=acct(spark, d), spark=spark)


@query("SELECT n_regionkey AS i, count(*) AS v FROM nation GROUP BY 1")
def text_edges(spark, d):
    """A text file of pairs, written to the shared folder and read back."""
    path = f"{shared_folder(spark)}/quillgrid/edges-{uuid.uuid4().hex}"
    table(spark, d, "nation").select("n_regionkey", "n_nationkey").write.csv(path, sep=" ")
    return q("[ <i=a,v=b.length> | (a,b) <- G, group by a ]", G=edges(spark, path, " "), spark=spark)


@query(f"WITH {_QTY}, r AS (SELECT i, j, v FROM qty) SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM r x JOIN r y ON x.j = y.j WHERE x.v > 60 AND y.v > 60 GROUP BY 1, 2")
def rows_matmul(spark, d):
    """A product of plain rows (index, index, value), no arrays."""
    rows = qty(spark, d).df.toDF("i", "j", "v")
    return q("[ <i=i,j=j,v=+/p> | (i,k,a) <- R, (j,kk,b) <- R, kk == k, a > 60.0, b > 60.0, let p = a*b, group by (i,j) ]", R=rows, spark=spark)


# ---------------------------------------------------------------- stores


@query(f"WITH {_EVT} SELECT i, j FROM evt WHERE v > 1")
def flattened(spark, d):
    """Bags of a group, flattened again to one row an element."""
    pairs = q("flatten([ (user,hour) | ((user,hour),c) <- E, c > 1, group by user ])", E=evt(spark, d), spark=spark)
    return pairs.select(F.col("_1").alias("i"), F.col("_2").alias("j"))


@query(f"WITH {_ACCT} SELECT (SELECT max(c_custkey) FROM customer) - i AS i, v * 2 AS v FROM acct")
def declared_storage(spark, d):
    """An array kept in a storage that the program declares: its places reversed."""
    a = acct(spark, d)
    text = """typemap turned[T](n: Int): array1[T] {
                def view(x: list[(Long,T)]) = [ (n-1-i,v) | (i,v) <- x ]
                def store(x: list[(Long,T)]) = [ (n-1-i,v) | (i,v) <- x ]
              }
              var W = turned(n)[ (n-1-i,v*2) | (i,v) <- A ];
              [ <i=i,v=v> | (i,v) <- W ];"""
    return q(text, A=a, n=a.dims[0], spark=spark)


@query(f"WITH {_ORD} SELECT i, v FROM ord")
def registered_storage(spark, d):
    """A storage of two callables on tables: values kept as their negation."""
    register_storage("negated", lambda t: t.selectExpr("k as _1", "-w as _2"), lambda t: t.selectExpr(f"{t.columns[0]} as k", f"-{t.columns[1]} as w"))
    kept = q("negated()[ (i,v) | (i,v) <- O ]", O=ord_(spark, d), spark=spark)
    return q("[ <i=i,v=v> | (i,v) <- W ]", W=kept, spark=spark)


@query(f"WITH {_EVT}, {_GRID} SELECT grid.i // 4 AS i, grid.j // 6 AS j, sum(coalesce(v, 0))::DOUBLE / count(*) AS v FROM grid LEFT JOIN evt ON evt.i = grid.i AND evt.j = grid.j GROUP BY 1, 2")
def coarse_mean(spark, d):
    """A mean by two computed indexes, into a dense matrix."""
    e = evt(spark, d)
    n = -(-e.dims[0] // 4)
    return _rows(q("tensor*(n,4)[ ((a,b),(+/w)/w.length) | ((user,hour),c) <= E, let w = c.toDouble, group by (a,b): (user/4,hour/6) ]", E=e, n=n, spark=spark))


# ---------------------------------------------------------------- expressions


@query("SELECT o_orderkey AS k, o_custkey % 7 IN (0, 2, 4, 6) AS even, abs(o_custkey - 100) AS far, o_orderstatus IN ('F', 'O') AND NOT o_orderpriority = '1-URGENT' AS calm FROM orders")
def predicates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return q('[ <k=k,even=inRange(c%7,0,6,2),far=abs(c-100),calm=((s == "F" || s == "O") && !(u == "1-URGENT"))> | (k,c,s,u) <- O ]', O=o, spark=spark)


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN -c_acctbal * 1.5 ELSE c_acctbal + 1 END AS fee FROM customer")
def function_body(spark, d):
    """A function of several statements."""
    text = "def fee(x: Double): Double = { var y = x; if (x < 0.0) { y = -x; y = y*1.5 } else y += 1.0; return y }; [ <k=k,fee=fee(b)> | (k,b) <- C ]"
    return q(text, C=table(spark, d, "customer").select("c_custkey", "c_acctbal"), spark=spark)


@query(f"WITH {_EVT} SELECT i, max(v * 100 + j) AS v FROM evt GROUP BY 1")
def lambda_reduce(spark, d):
    """A reduction by a lambda."""
    return q("var later = (a,b) => if (a > b) a else b; [ <i=user,v=later/w> | ((user,hour),c) <- E, let w = c*100+hour, group by user ]", E=evt(spark, d), spark=spark)


@query("SELECT vec_id, list_aggregate(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(floor(x * 8) AS BIGINT)), 'sum')::BIGINT AS s FROM embeddings")
def row_lists(spark, d):
    """A comprehension over an array of the row, as higher-order functions."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return q("[ <vec_id=i,s=+/[ floor(x*8.0) | x <- a, x > 0.0 ]> | (i,a) <- E ]", E=e, spark=spark)


@query("SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n, list_sort(list(DISTINCT l_linenumber)) AS some, max(l_linenumber) AS top, count(*) + 1 AS more FROM lineitem GROUP BY 1")
def list_functions(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    text = "[ <k=k,n=array_size(unique_values(x)),some=sort(unique_values(x)),top=max/x,more=array_size(x :+ 0)> | (k,x) <- L, group by k ]"
    got = q(text, L=line, spark=spark)
    return got.select("k", F.col("n").cast("bigint").alias("n"), "some", "top", F.col("more").cast("bigint").alias("more"))


@query("SELECT c_custkey AS k, CASE WHEN c_nationkey IN (1, 5, 8, 13, 21) THEN list_position([1, 5, 8, 13, 21], c_nationkey) - 1 ELSE -1 END AS at FROM customer")
def binary_search(spark, d):
    return q("[ <k=k,at=binarySearch(n,0,5,[1,5,8,13,21])> | (k,n) <- C ]", C=table(spark, d, "customer").select("c_custkey", "c_nationkey"), spark=spark)


@query("SELECT n_name AS name, upper(substr(n_name, 1, 2)) || '-' || n_nationkey AS code FROM nation")
def host_function(spark, d):
    """A function of the surroundings, on columns."""
    code = lambda name, key: F.concat(F.upper(F.substr(name, F.lit(1), F.lit(2))), F.lit("-"), key.cast("string"))
    return q("[ <name=n,code=code(n,k)> | (n,k) <- N ]", N=table(spark, d, "nation").select("n_name", "n_nationkey"), code=code, spark=spark)


# ---------------------------------------------------------------- groups and subqueries


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    n = q("[ k | k <- L ].length", L=table(spark, d, "lineitem").select("l_orderkey"), spark=spark)
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"))


@query(f"WITH {_QTY} SELECT 7 AS k, sum(v) AS v, count(*) AS n FROM qty")
def group_const_key(spark, d):
    return q("[ <k=k,v=+/v,n=v.length> | ((i,j),v) <- A, let k = 7, group by k ]", A=qty(spark, d), spark=spark)


@query("SELECT a.n_nationkey AS k, (SELECT count(*) FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey) AS before, (SELECT coalesce(sum(s.s_acctbal), 0) FROM supplier s WHERE s.s_nationkey > a.n_nationkey) AS after FROM nation a")
def correlated_inequality(spark, d):
    """Reductions tied to the row by inequalities."""
    n, s = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "supplier").select("s_nationkey", "s_acctbal")
    got = q("[ <k=k,before=[ x | (x,y) <- N, y == r, x < k ].length,after=+/[ b | (m,b) <- S, m > k ]> | (k,r) <- N ]", N=n, S=s, spark=spark)
    return got.select("k", F.col("before").cast("bigint").alias("before"), "after")


# ---------------------------------------------------------------- loops


@query(f"WITH {_EVT} SELECT u.i, coalesce(sum(evt.v), 0)::BIGINT AS total, count(evt.v)::BIGINT AS hours FROM (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) i) u LEFT JOIN evt ON evt.i = u.i GROUP BY 1")
def component_update(spark, d):
    """Loops that add to the components of an array's records."""
    e = evt(spark, d)
    text = "var T = tensor(n)[ (i,<total=0L,hours=0L>) | i <- 0..n-1 ]; for ((user,hour),c) in E do { T[user]#total += c; T[user]#hours += 1L }; [ <i=i,total=t#total,hours=t#hours> | (i,t) <- T ];"
    return q(text, E=e, n=e.dims[0], spark=spark)


@query(f"WITH {_ORD} SELECT i % 10 AS i, sum(v)::BIGINT AS v FROM ord GROUP BY 1")
def loop_over_rows(spark, d):
    """A loop over a collection, with a computed destination."""
    return _rows(q("var V = tensor*()(10)[ (i,0L) | i <- 0..9 ]; for (i,v) in O do V[i%10] += v; V;", O=ord_(spark, d), spark=spark))


@query(f"WITH {_ACCT} SELECT i, CASE WHEN v < 0 THEN 0 WHEN v > 500000 THEN v - 500000 ELSE v END AS v FROM acct")
def conditional_loop(spark, d):
    a = acct(spark, d)
    return _rows(q("for i = 0, n-1 do { if (A[i] < 0L) A[i] = 0L else if (A[i] > 500000L) A[i] = A[i]-500000L; }; A;", A=a, n=a.dims[0], spark=spark))


# ---------------------------------------------------------------- blocks


_E = "e AS (SELECT vec_id i, generate_subscripts(embedding, 1) - 1 k, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings)"


@query(f"WITH {_E} SELECT CAST(i AS BIGINT) AS i, round(sum(v * v), 9) AS v FROM e GROUP BY 1")
def blocked_norms(spark, d):
    """A reduction of a blocked matrix by rows."""
    e = emb(spark, d)
    got = q("tensor*(n)[ (i,+/p) | ((i,k),v) <- E, let p = v*v, group by i ]", E=e, n=e.dims[0], spark=spark)
    return got.df.select(F.col("i0").alias("i"), F.round("v", 9).alias("v"))


@query(f"WITH {_E} SELECT CAST(k AS BIGINT) AS i, CAST(i AS BIGINT) AS j, round(greatest(v, 0) * 2 - v * v, 9) + 0.0 AS v FROM e")
def blocked_map(spark, d):
    """Maps of blocked matrices at equal indexes, turned."""
    e = emb(spark, d)
    got = q("var D = tensor*(n,64)[ ((i,k),max(v,0.0)*2) | ((i,k),v) <- E ]; tensor*(64,n)[ ((k,i),a-b*b) | ((i,k),a) <- D, ((ii,kk),b) <- E, ii == i, kk == k ];", E=e, n=e.dims[0], spark=spark)
    return got.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), (F.round("v", 9) + F.lit(0.0)).alias("v"))


@query(f"WITH {_E} SELECT CAST(x.k AS BIGINT) AS i, CAST(y.k AS BIGINT) AS j, round(max(abs(x.v - y.v)), 9) AS v FROM e x JOIN e y ON x.i = y.i GROUP BY 1, 2")
def blocked_distance(spark, d):
    """Another reduction and function of two cells on blocks: the largest difference of two dimensions."""
    e = emb(spark, d)
    got = q("tensor*(64,64)[ ((a,b),max/p) | ((i,a),x) <- E, ((ii,b),y) <- E, ii == i, let p = abs(x-y), group by (a,b) ]", E=e, spark=spark)
    return got.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.round("v", 9).alias("v"))
