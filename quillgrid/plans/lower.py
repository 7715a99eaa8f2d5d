"""Comprehensions as DataFrames.

Qualifiers are lowered from left to right over a state: a DataFrame with columns of
generated names, the values that the program's names stand for, and which columns
identify a row.  Joins are written as cross joins followed by the program's
predicates; Catalyst turns those into equi-joins and picks the strategy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..lang import tree as t
from ..lang.tree import pretty
from ..session import config
from ..tensor import Tensor, store, zero
from . import tiled
from .rewrite import conjuncts, rewrite


class LoweringError(Exception):
    pass


# ---------------------------------------------------------------- values


@dataclass(frozen=True)
class Col:
    """A column; ``name`` if it is one of the state's own columns, ``offset`` if that plus a constant."""

    column: Column
    name: str | None = None


@dataclass(frozen=True)
class Tup:
    parts: tuple


@dataclass(frozen=True)
class Rec:
    parts: dict


@dataclass(frozen=True)
class Bag:
    """A name bound before a group-by: the group's values, each as it was in ``state``."""

    value: Any


@dataclass(frozen=True)
class Closure:
    params: Any
    body: Any
    scope: dict


@dataclass
class State:
    df: DataFrame | None = None
    scope: dict[str, Any] = field(default_factory=dict)
    key: frozenset | None = frozenset()  # columns that identify a row
    same: dict[str, str] = field(default_factory=dict)  # equal columns, by predicates
    covers: bool = True  # the rows are all combinations of the indexes in ``domains``
    domains: dict[str, int] = field(default_factory=dict)  # index columns that run over 0 to n - 1

    def top(self, n: str) -> str:
        while n in self.same:
            n = self.same[n]
        return n


def column(v: Any) -> Column:
    """A value as one column: tuples and records are structs."""
    if isinstance(v, Col):
        return v.column
    if isinstance(v, Column):
        return v
    if isinstance(v, Tup):
        return F.struct(*[column(p).alias(f"_{k + 1}") for k, p in enumerate(v.parts)])
    if isinstance(v, Rec):
        return F.struct(*[column(p).alias(n) for n, p in v.parts.items()])
    if isinstance(v, (list, tuple)):
        return F.array(*[column(x) for x in v])
    if isinstance(v, int) and not isinstance(v, bool):
        return F.lit(int(v)).cast("int" if -(2**31) <= v < 2**31 and not isinstance(v, t.Long) else "bigint")
    if isinstance(v, (bool, float, str)) or v is None:
        return F.lit(v)
    raise LoweringError(f"not a value of a row: {type(v).__name__}")


def is_row(v: Any) -> bool:
    return isinstance(v, (Col, Rec, Column)) or isinstance(v, Tup) and any(map(is_row, v.parts))


#: Declared storages: name -> (parameters, view, store); view and store are callables on tables or closures of the language.
STORAGES: dict[str, tuple] = {}


@dataclass(frozen=True)
class Stored:
    """An array in a declared storage, with the arguments it was made with."""

    name: str
    args: tuple
    table: Any


class Lowering:
    def __init__(self, spark: SparkSession, env: dict[str, Any], fresh: t.Fresh | None = None):
        self.spark, self.env = spark, env
        self.fresh = fresh or t.Fresh()
        self.count = 0

    def new(self, hint: str) -> str:
        self.count = self.fresh.count = self.fresh.count + 1
        return f"_{hint}_{self.count}"

    def is_array(self, name: str) -> bool:
        """Whether elements of a name are read by joining it: an array, or a distributed map."""
        v = self.env.get(name)
        return isinstance(v, Tensor) or isinstance(v, DataFrame) and v.columns == ["k", "v"]

    # ---- comprehensions

    def comprehension(self, c: t.Comprehension, outer: State | None = None, start: State | None = None) -> tuple[State, Any]:
        """The final state and the head's value; ``start``: rows that are there before the first qualifier."""
        c = rewrite(c, self.is_array, self.fresh)
        if config.trace:
            print(pretty(c))
        s = start or State(scope=dict(outer.scope) if outer else {})
        head, quals = c.head, list(c.quals)
        while quals:
            q = quals.pop(0)
            if isinstance(q, t.Generator):
                s = self.generator(q, s)
            elif isinstance(q, t.Let):
                s = replace(s, scope={**s.scope, **self.match(q.pattern, self.value(q.value, s), s)})
            elif isinstance(q, t.Where):
                s = self.where(q.test, s)
            else:
                s, quals, head = self.group(q, quals, head, s)
        if s.df is None:
            s = replace(s, df=self.spark.range(1).select(F.lit(0).alias(self.new("one"))), key=frozenset())
        s, head = self.prepare(head, s)
        return s, self.value(head, s)

    def generator(self, g: t.Generator, s: State) -> State:
        domain = g.domain
        if isinstance(domain, t.Range):
            low, high, step = (self.value(x, s) for x in (domain.low, domain.high, domain.step))
            n = self.new("i")
            if any(map(is_row, (low, high, step))):
                made = F.explode(F.sequence(column(low), column(high), column(step)))
                # an empty range is no reason to run backwards
                fits = s.df.filter(column(high) >= column(low))
                return self._bind(g.pattern, fits.withColumn(n, made), s, Col(F.col(n), n), {n}, covers=False)
            df = self.spark.range(low, high + (1 if step > 0 else -1), step).select(F.col("id").alias(n))
            whole = low == 0 and step == 1
            return self._bind(g.pattern, self._join(s, df), s, Col(F.col(n), n), {n}, covers=whole, domains={n: high + 1} if whole else None)
        if isinstance(domain, t.ListOf) and not domain.parts:
            parts = g.pattern.parts if isinstance(g.pattern, t.PTuple) else (g.pattern,)
            names = [self.new("c") for _ in parts]
            df = self.spark.range(0).select(*[F.col("id").alias(n) for n in names])
            value = tuple(Col(F.col(n), n) for n in names)
            return self._bind(g.pattern, self._join(s, df), s, value[0] if len(value) == 1 else Tup(value), None, covers=False)
        inner = self.value(domain, replace(s, df=None) if isinstance(domain, (t.Comprehension, t.TensorOf)) else s)
        if isinstance(inner, Stored):
            inner = self._through(inner.name, 1, inner.args, inner.table)
        if isinstance(inner, Tensor):
            names = [self.new("i") for _ in inner.dims]
            v = self.new("v")
            df = (inner.all_cells() if g.full else inner.cells()).toDF(*names, v)
            index = [Col(F.col(n), n) for n in names]
            return self._bind(g.pattern, self._join(s, df), s, Tup((index[0] if len(index) == 1 else Tup(tuple(index)), Col(F.col(v), v))), set(names), covers=g.full or not inner.is_sparse, domains=dict(zip(names, inner.dims, strict=True)))
        if isinstance(inner, (list, tuple)):
            inner = self.listed(list(inner))
        elif isinstance(inner, dict):
            inner = self.listed(list(inner.items()))
        if isinstance(inner, DataFrame):
            names = [self.new("c") for _ in inner.columns]
            parts = tuple(Col(F.col(n), n) for n in names)
            value = parts[0] if len(parts) == 1 else Rec(dict(zip(inner.columns, parts, strict=True))) if isinstance(g.pattern, t.PVar) else Tup(parts)
            return self._bind(g.pattern, self._join(s, inner.toDF(*names)), s, value, None, covers=False)
        if isinstance(inner, Bag):
            inner = inner.value
        if isinstance(inner, Col):
            n = self.new("e")
            kind = self.kind(inner, s)
            if isinstance(kind, T.MapType):
                k = self.new("k")
                return self._bind(g.pattern, s.df.select("*", F.explode(inner.column).alias(k, n)), s, Tup((Col(F.col(k), k), Col(F.col(n), n))), None, covers=False)
            return self._bind(g.pattern, s.df.withColumn(n, F.explode(inner.column)), s, Col(F.col(n), n), None, covers=False)
        raise LoweringError(f"no generator over {type(inner).__name__}")

    def listed(self, rows: list) -> DataFrame:
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        if not rows:
            raise LoweringError("the type of an empty list is not known")
        return self.spark.createDataFrame(rows, [f"_{k + 1}" for k in range(len(rows[0]))])

    def _join(self, s: State, df: DataFrame) -> DataFrame:
        return df if s.df is None else s.df.crossJoin(df)

    def _bind(self, p: t.Node, df: DataFrame, s: State, v: Any, key: set | None, covers: bool = True, domains: dict | None = None) -> State:
        out = replace(s, df=df, key=s.key | key if s.key is not None and key is not None else None, covers=s.covers and covers, domains={**s.domains, **(domains or {})})
        return replace(out, scope={**s.scope, **self.match(p, v, out)})

    def where(self, e: t.Node, s: State) -> State:
        for test in conjuncts(e):
            s, test = self.prepare(test, s)
            v = self.value(test, s)
            if v is True:
                continue
            covers = False
            if isinstance(test, t.Binary) and test.op == "==":
                a, b = self.value(test.left, s), self.value(test.right, s)
                if isinstance(a, Col) and isinstance(b, Col) and a.name and b.name and s.top(a.name) != s.top(b.name):
                    # two free indexes of one size, made equal, still take every value
                    covers = s.covers and s.domains.get(s.top(a.name), -1) == s.domains.get(s.top(b.name), -2)
                    s = replace(s, same={**s.same, s.top(b.name): s.top(a.name)})
            if s.df is None:
                s = replace(s, df=self.spark.range(1).select(F.lit(0).alias(self.new("one"))))
            s = replace(s, df=s.df.filter(column(v)), covers=covers)
        return s

    # ---- grouping

    def group(self, g: t.GroupBy, rest: list, head: t.Node, s: State) -> tuple[State, list, t.Node]:
        """One aggregation for all reductions that the rest of the comprehension needs."""
        s, key_expression = self.prepare(g.key, s)
        key = self.value(key_expression, s)
        lifted = {n for n, v in s.scope.items() if is_row(v)} - set(t.bound(g.pattern))
        # a let of a constant is a bag as well, where it is reduced
        plain = {n for n, v in s.scope.items() if isinstance(v, (int, float, str, bool))} - set(t.bound(g.pattern))
        wanted: dict[str, tuple] = {}

        def lift(n: Any, hidden: frozenset = frozenset()) -> Any:
            """``n`` with its uses of bags replaced by names of aggregates."""
            bag = lambda x: isinstance(x, t.Name) and x.name in lifted and x.name not in hidden
            value = lambda x: bag(x) or isinstance(x, t.Name) and x.name in plain and x.name not in hidden
            spec = None
            if isinstance(n, t.Reduce) and (value(n.of) or isinstance(n.of, t.Comprehension) and n.of.quals and isinstance(n.of.quals[0], t.Generator) and bag(n.of.quals[0].domain)):
                spec = ("reduce", n.op, n.of)
            elif isinstance(n, t.Method) and n.name in ("length", "size") and bag(n.of):
                spec = ("count",)
            elif bag(n):
                spec = ("bag", n.name)
            if spec is not None:
                for name, x in wanted.items():
                    if x == spec:
                        return t.Name(name)
                name = self.fresh("agg")
                wanted[name] = spec
                return t.Name(name)
            if isinstance(n, t.Lambda):
                return t.Lambda(n.params, lift(n.body, hidden | set(t.bound(n.params))))
            if isinstance(n, t.Comprehension):
                quals, hide = [], hidden
                for q in n.quals:
                    quals.append(t.rebuild(q, lambda c: lift(c, hide)) if not hasattr(q, "pattern") else t.rebuild(q, lambda c: c if isinstance(c, (t.PVar, t.PTuple, t.PAny)) else lift(c, hide)))  # noqa: B023
                    if hasattr(q, "pattern"):
                        hide = hide | set(t.bound(q.pattern))
                return t.Comprehension(lift(n.head, hide), tuple(quals))
            return t.rebuild(n, lambda c: lift(c, hidden))

        new_rest, hide = [], frozenset()
        for q in rest:
            if isinstance(q, t.Where):
                new_rest.append(t.Where(lift(q.test, hide)))
            elif isinstance(q, t.Let):
                new_rest.append(t.Let(q.pattern, lift(q.value, hide)))
            elif isinstance(q, t.Generator):
                new_rest.append(t.Generator(q.pattern, lift(q.domain, hide), q.full))
            else:
                new_rest.append(t.GroupBy(q.pattern, lift(q.key, hide)))
            if not isinstance(q, t.Where):
                hide = hide | set(t.bound(q.pattern))
        new_head = lift(head, hide)

        names: list[str] = []
        columns: list[Column] = []

        def flat(v: Any) -> Any:
            if isinstance(v, Tup):
                return Tup(tuple(map(flat, v.parts)))
            if isinstance(v, Rec):
                return Rec({k: flat(x) for k, x in v.parts.items()})
            n = self.new("k")
            names.append(n)
            columns.append(column(v).alias(n))
            return Col(F.col(n), n)

        scope = {n: v for n, v in s.scope.items() if not is_row(v)}
        grouped = flat(key) if is_row(key) else key
        single = s.key is not None and self._identifies(key, s)
        made: dict[str, Column] = {}
        for name, spec in wanted.items():
            made[name] = self._aggregate(spec, s, single).alias(f"_{name.replace('$', '_')}")
        if single:  # every group is one row: no shuffle
            df = s.df.select(*columns, *made.values())
        elif columns:
            named = s.df.select("*", *columns)
            df = named.groupBy(*names).agg(*made.values()) if made else named.select(*names).distinct()
        else:  # a constant key: one group, or none
            some = self.new("n")
            df = s.df.agg(F.count(F.lit(1)).alias(some), *made.values()).filter(F.col(some) > 0)
        plain_key = self._plain(grouped)
        free = {s.top(n) for n in self._plain(key)}
        domains = {}
        if len(free) == len(names) == len(plain_key):
            domains = {k: s.domains[s.top(n)] for k, n in zip(names, self._plain(key), strict=True) if s.top(n) in s.domains}
        out = State(df, scope, frozenset(names), {}, s.covers and len(domains) == len(names) > 0, domains)
        for name in wanted:
            n = f"_{name.replace('$', '_')}"
            out.scope[name] = Col(F.col(n), n)
        out.scope.update(self.match(g.pattern, grouped, out))
        return out, new_rest, new_head

    def _identifies(self, key: Any, s: State) -> bool:
        """Whether rows with one key are one row."""
        have = {s.top(n) for n in self._plain(key)}
        return bool(have) and {s.top(n) for n in s.key} <= have

    def _plain(self, v: Any) -> list[str]:
        """Names of the columns that a key holds unchanged."""
        if isinstance(v, Tup):
            return [n for p in v.parts for n in self._plain(p)]
        if isinstance(v, Rec):
            return [n for p in v.parts.values() for n in self._plain(p)]
        return [v.name] if isinstance(v, Col) and v.name else []

    def _aggregate(self, spec: tuple, s: State, single: bool) -> Column:
        if spec[0] == "count":
            return F.lit(1).cast("bigint") if single else F.count(F.lit(1))
        if spec[0] == "bag":
            c = column(s.scope[spec[1]])
            return F.array(c) if single else F.collect_list(c)
        _, op, of = spec
        if isinstance(of, t.Name):
            v = s.scope[of.name]
            return self._reduced(op, v, None, s, single)
        # a reduction of a mapped and filtered bag: its first generator is the group itself
        inner = replace(s, scope={**s.scope, **self.match(of.quals[0].pattern, s.scope[of.quals[0].domain.name], s)})
        test: Column | None = None
        for q in of.quals[1:]:
            if isinstance(q, t.Let):
                inner = replace(inner, scope={**inner.scope, **self.match(q.pattern, self.value(q.value, inner), inner)})
            elif isinstance(q, t.Where):
                c = column(self.value(q.test, inner))
                test = c if test is None else test & c
            else:
                raise LoweringError("a reduction over a bag takes lets and predicates only")
        return self._reduced(op, self.value(of.head, inner), test, inner, single)

    def _reduced(self, op: str, v: Any, test: Column | None, s: State, single: bool) -> Column:
        if isinstance(v, Tup):
            raise LoweringError("a reduction takes one value, not a tuple")
        c, user = column(v), None
        kind = self.kind(Col(c), s)
        if op not in scalars.MONOIDS:
            user = self._function(op)
        empty = None if user else scalars.MONOIDS[op][2]
        if test is not None:
            c = F.when(test, c)
        if single:
            out = c
        else:
            out = scalars.aggregate(op, c, kind, user)
        if test is not None and empty is not None and op != "++":
            out = F.coalesce(out, F.lit(empty))
        return out.cast("bigint") if op == "+" and isinstance(kind, T.IntegralType) else out

    def _function(self, name: str) -> Callable:
        f = self.env.get(name)
        if isinstance(f, Closure):
            def folded(a: Any, b: Any) -> Any:
                plain = not isinstance(a, Column) and not isinstance(b, Column)
                out = self.apply(f, [a, b] if plain else [Col(column(a)), Col(column(b))], State())
                return out if plain else column(out)

            return folded
        if callable(f):
            return f
        if name in scalars.FUNCTIONS:
            return scalars.FUNCTIONS[name]
        raise LoweringError(f"no function {name} to reduce with")

    # ---- subqueries

    def prepare(self, e: t.Node, s: State) -> tuple[State, t.Node]:
        """Bring the reductions of comprehensions in ``e`` into the state as columns."""
        found: list[t.Reduce] = []

        def seek(n: Any) -> None:
            if isinstance(n, (t.Comprehension, t.Lambda)):
                return
            if isinstance(n, t.Reduce) and isinstance(n.of, t.Comprehension) or isinstance(n, t.Method) and n.name == "length" and isinstance(n.of, t.Comprehension):
                if not in_row(n.of):
                    found.append(n)
                return
            if isinstance(n, t.TensorOf) and isinstance(n.of, t.Comprehension):
                if n.of.quals and isinstance(n.of.quals[0], t.Generator) and isinstance(n.of.quals[0].domain, t.Name) and n.of.quals[0].domain.name not in s.scope and self.is_array(n.of.quals[0].domain.name):
                    nested.append(n)
                return
            for c in t.children(n):
                if isinstance(c, (t.Node, tuple)):
                    seek(c)

        def in_row(c: t.Comprehension) -> bool:
            """Over an array of the row itself."""
            q = c.quals[0] if c.quals else None
            return isinstance(q, t.Generator) and isinstance(q.domain, t.Name) and isinstance(s.scope.get(q.domain.name), Col)

        nested: list[t.TensorOf] = []
        seek(e)
        if s.df is None:
            return s, e
        new: dict[t.Node, t.Node] = {}
        for x in nested:
            # an array inside a value is bounded by its declared size: one row, sent to all tasks
            over = self.env[x.of.quals[0].domain.name]
            n, name = self.new("a"), self.fresh("array")
            index = F.struct(*[F.col(i).alias(f"_{k + 1}") for k, i in enumerate(over.index)]) if over.rank > 1 else F.col("i0")
            one = over.cells().agg(F.sort_array(F.collect_list(F.struct(index.alias("_1"), F.col("v").alias("_2")))).alias(n))
            s = replace(s, df=s.df.crossJoin(F.broadcast(one)), scope={**s.scope, name: Col(F.col(n))})
            first = t.Generator(x.of.quals[0].pattern, t.Name(name))
            new[x] = t.TensorOf(x.dense, x.sparse, t.Comprehension(x.of.head, (first, *x.of.quals[1:])), x.blocked)
        for r in found:
            name = self.fresh("sub")
            s, value = self._subquery(r, s)
            s = replace(s, scope={**s.scope, name: value})
            new[r] = t.Name(name)

        def swap(n: Any) -> Any:
            if isinstance(n, t.Node) and n in new:
                return new[n]
            return t.rebuild(n, swap)

        return s, swap(e) if new else e

    def _subquery(self, r: t.Node, s: State) -> tuple[State, Any]:
        """A reduction beside the rows: one row for all, or by the equalities that tie it to the row (a left join on the aggregate)."""
        op = r.op if isinstance(r, t.Reduce) else "length"
        c = r.of
        outer = {n for n, v in s.scope.items() if is_row(v)}
        c = rewrite(c, self.is_array, self.fresh)
        known: set[str] = set()
        for q in c.quals:
            if hasattr(q, "pattern"):
                known |= set(t.bound(q.pattern))
        if not (t.free(c) & outer):
            value = self.reduced(t.Reduce(op, c) if op != "length" else r, State(scope={n: v for n, v in s.scope.items() if not is_row(v)}))
            if not isinstance(value, DataFrame):
                return s, value
            n = self.new("s")
            return replace(s, df=s.df.crossJoin(F.broadcast(value.toDF(n)))), Col(F.col(n), n)
        if not self._tied(c, outer, known):
            return self._beside(op, c, outer - known, s)
        inner, ties = [], []
        for q in c.quals:
            if not (t.free(q.test if isinstance(q, t.Where) else q.domain if isinstance(q, t.Generator) else q.value if isinstance(q, t.Let) else q.key) & (outer - known)):
                inner.append(q)
                continue
            for test in conjuncts(q.test):
                a, b = test.left, test.right
                ties.append((b, a) if t.free(a) & (outer - known) else (a, b))
        static = State(scope={n: v for n, v in s.scope.items() if not is_row(v)})
        state, head = self.comprehension(t.Comprehension(t.Tuple((t.Tuple(tuple(a for a, _ in ties)), c.head)), tuple(inner)), static)
        keys = [self.new("t") for _ in ties]
        total = self.new("s")
        by = state.df.select(*[column(v).alias(k) for v, k in zip(head.parts[0].parts, keys, strict=True)], column(head.parts[1]).alias(total))
        kind = by.schema[total].dataType
        agg = F.count(F.lit(1)) if op == "length" else scalars.aggregate(op, F.col(total), kind, None if op in scalars.MONOIDS else self._function(op))
        by = by.groupBy(*keys).agg(agg.alias(total))
        on = None
        for k, (_, b) in zip(keys, ties, strict=True):
            test = F.col(k) == column(self.value(b, s))
            on = test if on is None else on & test
        empty = 0 if op == "length" else scalars.MONOIDS[op][2] if op in scalars.MONOIDS else None
        v = F.col(total) if empty is None or op == "++" else F.coalesce(F.col(total), F.lit(empty).cast(by.schema[total].dataType))
        return replace(s, df=s.df.join(by, on, "left")), Col(v)

    def _tied(self, c: t.Comprehension, outer: set[str], known: set[str]) -> bool:
        """Whether all that ties a comprehension to the row are equalities of something of its own and something of the row."""
        for q in c.quals:
            if isinstance(q, t.Where):
                for test in conjuncts(q.test):
                    if not t.free(test) & (outer - known):
                        continue
                    if not (isinstance(test, t.Binary) and test.op == "=="):
                        return False
                    sides = [bool(t.free(x) & (outer - known)) for x in (test.left, test.right)]
                    if all(sides) or t.free(test.right if sides[1] else test.left) & known:
                        return False
            elif t.free(t.rebuild(q, lambda x: x)) & (outer - known) - set(t.bound(q.pattern)):
                return False
        return not t.free(c.head) & (outer - known)

    def _beside(self, op: str, c: t.Comprehension, names: set[str], s: State) -> tuple[State, Any]:
        """A reduction tied to the row in any way: computed for each distinct combination of what it takes from the row."""
        used = sorted(n for n in t.free(c) & names if is_row(s.scope.get(n)))
        keys = [self.new("o") for _ in used]
        rows = s.df.select(*[column(s.scope[n]).alias(k) for n, k in zip(used, keys, strict=True)]).distinct()
        own = {n: self._shaped(s.scope[n], F.col(k)) for n, k in zip(used, keys, strict=True)}
        start = State(rows, {**{n: v for n, v in s.scope.items() if not is_row(v)}, **own}, None, {}, False)
        state, head = self.comprehension(c, start=start)
        total = self.new("s")
        by = state.df.select(*keys, column(head).alias(total))
        kind = by.schema[total].dataType
        agg = F.count(F.lit(1)) if op == "length" else scalars.aggregate(op, F.col(total), kind, None if op in scalars.MONOIDS else self._function(op))
        by = by.groupBy(*keys).agg(agg.alias(total))
        renamed = [self.new("t") for _ in keys]
        by = by.toDF(*renamed, total)
        on = F.lit(True)
        for n, k in zip(used, renamed, strict=True):
            on = on & column(s.scope[n]).eqNullSafe(F.col(k))
        empty = 0 if op == "length" else scalars.MONOIDS[op][2] if op in scalars.MONOIDS else None
        v = F.col(total) if empty is None or op == "++" else F.coalesce(F.col(total), F.lit(empty).cast(by.schema[total].dataType))
        return replace(s, df=s.df.join(by, on, "left")), Col(v)

    def _shaped(self, v: Any, c: Column) -> Any:
        """A row's value as parts of the column that holds it."""
        if isinstance(v, Tup):
            return Tup(tuple(self._shaped(p, c.getField(f"_{k + 1}")) for k, p in enumerate(v.parts)))
        if isinstance(v, Rec):
            return Rec({n: self._shaped(p, c.getField(n)) for n, p in v.parts.items()})
        return Col(c)

    def reduced(self, r: t.Node, outer: State | None = None) -> Any:
        """A total reduction as a table of one row and column; a plain value where nothing is distributed."""
        op = r.op if isinstance(r, t.Reduce) else "length"
        if isinstance(r.of, t.Comprehension):
            s, head = self.comprehension(r.of, outer)
        else:
            v = self.value(r.of, outer or State())
            if isinstance(v, (list, tuple)):
                if op == "length":
                    return len(v)
                if not v:
                    return scalars.MONOIDS[op][2]
                fold = scalars.MONOIDS[op][3] if op in scalars.MONOIDS else self._function(op)
                out = v[0]
                for x in v[1:]:
                    out = fold(out, x)
                return out
            if isinstance(v, Tensor):
                s, head = State(v.cells()), Col(F.col("v"))
            elif isinstance(v, DataFrame):
                s, head = State(v), Col(F.col(v.columns[0]))
            else:
                raise LoweringError(f"no reduction of {type(v).__name__}")
        if op == "length":
            return s.df.agg(F.count(F.lit(1)).alias("value"))
        c = column(head)
        kind = self.kind(Col(c), s)
        user = None if op in scalars.MONOIDS else self._function(op)
        agg = scalars.aggregate(op, c, kind, user)
        if not user and scalars.MONOIDS[op][2] is not None and op != "++":
            agg = F.coalesce(agg, F.lit(scalars.MONOIDS[op][2]))
        if op == "+" and isinstance(kind, T.IntegralType):
            agg = agg.cast("bigint")
        return s.df.agg(agg.alias("value"))

    # ---- expressions

    def kind(self, v: Any, s: State) -> T.DataType:
        df = s.df if s.df is not None else self.spark.range(1)
        return df.select(column(v).alias("x")).schema["x"].dataType

    def match(self, p: t.Node, v: Any, s: State) -> dict[str, Any]:
        if isinstance(p, t.PAny):
            return {}
        if isinstance(p, t.PVar):
            return {p.name: v}
        if isinstance(v, Rec):
            parts = list(v.parts.values())
        elif isinstance(v, Tup):
            parts = list(v.parts)
        elif isinstance(v, Bag):
            return self.match(p, v.value, s)
        elif isinstance(v, Col):
            kind = self.kind(v, s)
            if not isinstance(kind, T.StructType):
                raise LoweringError(f"a pattern of {len(p.parts)} parts meets a {kind.simpleString()}")
            parts = [Col(v.column.getField(f.name)) for f in kind.fields]
        elif isinstance(v, (tuple, list)):
            parts = list(v)
        else:
            raise LoweringError(f"a pattern of {len(p.parts)} parts meets a {type(v).__name__}")
        if len(parts) != len(p.parts):
            raise LoweringError(f"a pattern of {len(p.parts)} parts meets {len(parts)} values")
        out: dict[str, Any] = {}
        for q, x in zip(p.parts, parts, strict=True):
            out.update(self.match(q, x, s))
        return out

    def value(self, e: t.Node, s: State) -> Any:
        f = getattr(self, f"_{type(e).__name__.lower()}", None)
        if f is None:
            raise LoweringError(f"{type(e).__name__} is no expression")
        return f(e, s)

    def _const(self, e: t.Const, s: State) -> Any:
        return e.value

    def _name(self, e: t.Name, s: State) -> Any:
        if e.name in s.scope:
            return s.scope[e.name]
        if e.name in self.env:
            return self.env[e.name]
        raise LoweringError(f"the name {e.name} is not bound")

    def _tuple(self, e: t.Tuple, s: State) -> Any:
        parts = tuple(self.value(p, s) for p in e.parts)
        return Tup(parts) if any(map(is_row, parts)) else parts

    def _record(self, e: t.Record, s: State) -> Any:
        return Rec({n: self.value(p, s) for n, p in zip(e.names, e.parts, strict=True)})

    def _part(self, e: t.Part, s: State) -> Any:
        v = self.value(e.of, s)
        if isinstance(v, Rec):
            return v.parts[e.key] if isinstance(e.key, str) else list(v.parts.values())[e.key - 1]
        if isinstance(v, Tup):
            return v.parts[e.key - 1]
        if isinstance(v, (tuple, list)):
            return v[e.key - 1]
        return Col(column(v).getField(e.key if isinstance(e.key, str) else f"_{e.key}"))

    def _binary(self, e: t.Binary, s: State) -> Any:
        a, b = self.value(e.left, s), self.value(e.right, s)
        if e.op in ("==", "!=") and (isinstance(a, Tup) or isinstance(b, Tup)):
            a, b = Col(column(a if not isinstance(a, tuple) else Tup(a))), Col(column(b if not isinstance(b, tuple) else Tup(b)))
        rows = is_row(a) or is_row(b)
        x, y = (column(a), column(b)) if rows else (a, b)
        if e.op == "/":
            whole = rows and all(isinstance(self.kind(v, s), T.IntegralType) for v in (a, b))
            out = scalars.divide(x, y, whole)
        elif e.op in scalars.OPERATORS:
            out = scalars.OPERATORS[e.op](x, y)
        elif callable(self.env.get(e.op)):
            out = self.env[e.op](x, y)
        else:
            raise LoweringError(f"no operator {e.op}")
        return Col(out) if rows else out

    def _unary(self, e: t.Unary, s: State) -> Any:
        v = self.value(e.of, s)
        if not is_row(v):
            return {"-": lambda x: -x, "+": lambda x: x, "!": lambda x: not x}[e.op](v)
        c = column(v)
        return Col({"-": lambda: -c, "+": lambda: c, "!": lambda: ~c}[e.op]())

    def _if(self, e: t.If, s: State) -> Any:
        test = self.value(e.test, s)
        if not is_row(test):
            return self.value(e.yes if test else e.no, s)
        yes, no = self.value(e.yes, s), self.value(e.no, s) if e.no is not None else None
        if isinstance(yes, Tup) and isinstance(no, Tup):
            return Tup(tuple(Col(F.when(column(test), column(a)).otherwise(column(b))) for a, b in zip(yes.parts, no.parts, strict=True)))
        return Col(F.when(column(test), column(yes)).otherwise(column(no)))

    def _match(self, e: t.Match, s: State) -> Any:
        v = self.value(e.of, s)
        out, chain = None, None
        for p, guard, body in e.cases:
            inner = replace(s, scope={**s.scope, **self.match(p, v, s)})
            test = self.value(guard, inner) if guard is not None else True
            if not is_row(test):
                if not test:
                    continue
                got = self.value(body, inner)
                return got if chain is None else Col(chain.otherwise(column(got)))
            got = column(self.value(body, inner))
            chain = F.when(column(test), got) if chain is None else chain.when(column(test), got)
        return Col(chain) if chain is not None else out

    def _lambda(self, e: t.Lambda, s: State) -> Any:
        return Closure(e.params, e.body, s.scope)

    def apply(self, f: Closure, args: list, s: State) -> Any:
        params = f.params
        if isinstance(params, t.PTuple) and len(params.parts) == len(args) and len(args) > 1:
            scope = {k: v for p, a in zip(params.parts, args, strict=True) for k, v in self.match(p, a, s).items()}
        else:
            if isinstance(params, t.PTuple) and len(params.parts) == 1:
                params = params.parts[0]
            scope = self.match(params, args[0] if len(args) == 1 else Tup(tuple(args)), s)
        return self.value(f.body, replace(s, scope={**s.scope, **f.scope, **scope}))

    def _through(self, name: str, which: int, args: tuple, table_: Any) -> Any:
        """A table through a declared storage's view (1) or store (2)."""
        params, f = STORAGES[name][0], STORAGES[name][which]
        if isinstance(f, Closure):
            scope = dict(zip(params, args, strict=True))
            return self.apply(Closure(f.params, f.body, {**f.scope, **scope}), [table_], State(scope=scope))
        return f(table_, *args)

    def _call(self, e: t.Call, s: State) -> Any:
        if e.name in STORAGES and e.name not in self.env:
            *args, of = [self.value(a, s) for a in e.args]
            if isinstance(of, Stored):
                of = self._through(of.name, 1, of.args, of.table)
            return Stored(e.name, tuple(args), self._through(e.name, 2, tuple(args), of.cells() if isinstance(of, Tensor) else of))
        if e.name in ("map", "rdd", "dataset", "block_map", "list") and len(e.args) == 1 and e.name not in self.env:
            v = self.value(e.args[0], s)
            if isinstance(v, Tensor):
                v = v.df
            if isinstance(v, DataFrame):
                if e.name in ("map", "block_map"):
                    v = v.toDF("k", "v")
                    return v.repartition("k") if e.name == "block_map" else v
                return v
            return dict(v) if e.name in ("map", "block_map") and isinstance(v, list) else v
        if e.name == "cache" and len(e.args) == 1:
            v = self.value(e.args[0], s)
            return v.persist() if isinstance(v, (Tensor, DataFrame)) else v
        if e.name == "flatten" and "flatten" not in self.env:
            return self._flat(self.value(e.args[-1], s), s)
        f = s.scope.get(e.name, self.env.get(e.name))
        if len(e.args) == 2 and isinstance(e.args[0], t.Lambda) and e.name in ("transform", "filter") and f is None:
            return self._higher(e, s)
        args = [self.value(a, s) for a in e.args]
        if isinstance(f, Closure):
            return self.apply(f, args, s)
        if e.name == "random":
            self.count = self.fresh.count = self.fresh.count + 1  # each call draws numbers of its own
            return Col(F.rand(41 + self.count))
        if f is None:
            f = scalars.FUNCTIONS.get(e.name)
        if isinstance(f, Tensor) or f is None or not callable(f):
            raise LoweringError(f"no function {e.name}")
        if any(map(is_row, args)):
            out = f(*[column(a) if is_row(a) else a for a in args])
            return Col(out) if isinstance(out, Column) else out
        return f(*args)

    def _flat(self, v: Any, s: State) -> Any:
        """An array of arrays as one array; of a table with arrays, one row for each of their elements, in the array's order."""
        if isinstance(v, Tensor):
            v = v.df.select("v")
        if isinstance(v, DataFrame):
            last = v.columns[-1]
            return v.select(*v.columns[:-1], F.explode(last).alias(last))
        if isinstance(v, (list, tuple)):
            return [x for part in v for x in part]
        kind = self.kind(v, s) if is_row(v) else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            return Col(F.flatten(column(v)))
        raise LoweringError("flatten takes arrays of arrays")

    def _higher(self, e: t.Call, s: State) -> Any:
        """transform{ v => [ ... | x <- v ] } array: a comprehension over one array column."""
        f, over = e.args[0], self.value(e.args[1], s)
        return self.value(f.body, replace(s, scope={**s.scope, f.params.name: over}))

    def _method(self, e: t.Method, s: State) -> Any:
        if isinstance(e.of, t.Name) and (e.of.name, e.name) in scalars.CONSTANTS and e.of.name not in self.env:
            return scalars.CONSTANTS[e.of.name, e.name]
        if e.name in ("length", "size") and isinstance(e.of, t.Comprehension):
            if s.df is not None and (v := self._in_row(e.of, s)) is not None:
                return Col(F.size(v.column))
            return self.reduced(e, s).first()[0]
        v = self.value(e.of, s)
        if isinstance(v, Tensor) and e.name in ("rows", "cols", "length", "dims"):
            return getattr(v, e.name)
        if isinstance(v, DataFrame) and e.name == "length":
            return v.count()
        args = [self.value(a, s) for a in e.args or ()]
        if e.name not in scalars.METHODS:
            raise LoweringError(f"no method {e.name}")
        if is_row(v) or any(map(is_row, args)):
            return Col(scalars.METHODS[e.name](column(v), *map(column, args)))
        return scalars.METHODS[e.name](v, *args)

    def _index(self, e: t.Index, s: State) -> Any:
        v = self.value(e.of, s)
        at = [self.value(a, s) for a in e.at]
        if isinstance(v, Tensor):
            if any(map(is_row, at)):
                raise LoweringError("an array is read by a row's index in comprehensions only")
            row = v.df.filter(" and ".join(f"i{k} = {int(a)}" for k, a in enumerate(at))).select("v").first()
            return row[0] if row else None
        if isinstance(v, DataFrame):
            if any(map(is_row, at)):
                raise LoweringError("a map is read by a row's key in comprehensions only")
            row = v.filter(F.col(v.columns[0]) == column(at[0] if len(at) == 1 else Tup(tuple(at)))).select(v.columns[1]).first()
            return row[0] if row else None
        if isinstance(v, (dict, list, tuple)) and any(map(is_row, at)):
            # a local map or list is a constant of the plan
            if isinstance(v, dict):
                made = F.map_from_entries(F.array(*[F.struct(column(k), column(x)) for k, x in v.items()]))
                return Col(F.try_element_at(made, column(at[0])))
            c = column(v)
            for a in at:
                c = F.get(c, column(a).cast("int"))
            return Col(c)
        if isinstance(v, dict):
            return v.get(at[0] if len(at) == 1 else tuple(at))
        if is_row(v):
            c = column(v)
            if isinstance(self.kind(Col(c), s), T.MapType):
                return Col(F.try_element_at(c, column(at[0])))
            for a in at:
                c = F.get(c, column(a))
            return Col(c)
        for a in at:
            v = v[a]
        return v

    def _range(self, e: t.Range, s: State) -> Any:
        low, high, step = (self.value(x, s) for x in (e.low, e.high, e.step))
        if any(map(is_row, (low, high, step))):
            return Col(F.when(column(high) >= column(low), F.sequence(column(low), column(high), column(step))).otherwise(F.array().cast("array<bigint>")))
        return list(range(low, high + (1 if step > 0 else -1), step))

    def _listof(self, e: t.ListOf, s: State) -> Any:
        parts = [self.value(p, s) for p in e.parts]
        return Col(F.array(*map(column, parts))) if any(map(is_row, parts)) else parts

    def _cast(self, e: t.Cast, s: State) -> Any:
        v = self.value(e.of, s)
        return cast(v, e.type)

    def _reduce(self, e: t.Reduce, s: State) -> Any:
        v = None
        if not isinstance(e.of, t.Comprehension):
            v = self.value(e.of, s)
        elif s.df is not None:
            v = self._in_row(e.of, s)
            if v is None:
                raise LoweringError("a reduction inside a row was not prepared")
        if isinstance(v, Col) and isinstance(self.kind(v, s), T.ArrayType):
            fold = scalars.MONOIDS[e.op][1] if e.op in scalars.MONOIDS else self._function(e.op)
            first, element = F.get(v.column, F.lit(0)), self.kind(v, s).elementType
            made = F.aggregate(F.slice(v.column, F.lit(2), F.greatest(F.size(v.column) - 1, F.lit(0))), first, lambda a, x: fold(a, x).cast(element))
            empty = scalars.MONOIDS[e.op][2] if e.op in scalars.MONOIDS else None
            return Col(made if empty is None or e.op == "++" else F.coalesce(made, F.lit(empty).cast(element)))
        out = self.reduced(e, s)
        return out.first()[0] if isinstance(out, DataFrame) else out

    def _comprehension(self, e: t.Comprehension, s: State) -> Any:
        if s.df is not None and (arr := self._in_row(e, s)) is not None:
            return arr
        static = State(scope={n: v for n, v in s.scope.items() if not is_row(v)})
        state, head = self.comprehension(e, static)
        return table(state.df, head)

    def _in_row(self, e: t.Comprehension, s: State) -> Any:
        """A comprehension over an array of the row, or (the array being bounded by its declared size) over a tensor, as an array column."""
        q = e.quals[0] if e.quals else None
        if not isinstance(q, t.Generator) or any(isinstance(x, (t.GroupBy, t.Generator)) for x in e.quals[1:]):
            return None
        over = self.value(q.domain, s)
        if isinstance(over, Bag):
            over = over.value
        if not isinstance(over, Col):
            return None
        return Col(self._transformed(e, q, over.column, s))

    def _transformed(self, e: t.Comprehension, q: t.Generator, over: Column, s: State) -> Column:
        kind = self.kind(Col(over), s).elementType

        def shape(c: Column, k: T.DataType) -> Any:
            if isinstance(k, T.StructType) and [f.name for f in k.fields] == [f"_{n + 1}" for n in range(len(k.fields))]:
                return Tup(tuple(shape(c.getField(f.name), f.dataType) for f in k.fields))
            return Col(c)

        def inner(c: Column) -> State:
            out = replace(s, scope={**s.scope, **self.match(q.pattern, shape(c, kind), s)})
            for x in e.quals[1:]:
                if isinstance(x, t.Let):
                    out = replace(out, scope={**out.scope, **self.match(x.pattern, self.value(x.value, out), out)})
            return out

        def keeps(test: t.Node) -> Callable:
            return lambda c: column(self.value(test, inner(c)))

        for x in e.quals[1:]:
            if isinstance(x, t.Where):
                over = F.filter(over, keeps(x.test))
        return F.transform(over, lambda c: column(self.value(e.head, inner(c))))

    def _tensorof(self, e: t.TensorOf, s: State) -> Any:
        dims = [self.value(d, s) for d in (*e.dense, *e.sparse)]
        if s.df is not None:
            return self._nested(e, dims, s)
        if isinstance(e.of, t.Comprehension):
            plain = {n: v for n, v in s.scope.items() if not is_row(v)}
            if (made := tiled.plan(e, tuple(map(int, dims)), {**self.env, **plain})) is not None:
                return made
            static = State(scope=plain)
            state, head = self.comprehension(e.of, static)
            return self.stored(state, head, tuple(map(int, dims)), len(e.dense))
        v = self.value(e.of, s)
        return coerce(v, tuple(map(int, dims)), len(e.dense))

    def stored(self, s: State, head: Any, dims: tuple[int, ...], dense: int) -> Tensor:
        """Head (index, value) rows as a tensor."""
        if not isinstance(head, Tup) or len(head.parts) != 2:
            raise LoweringError("an array is built from pairs of an index and a value")
        index, v = head.parts
        if isinstance(index, Col) and len(dims) > 1:
            index = Tup(tuple(self.match(t.PTuple(tuple(t.PVar(str(k)) for k in range(len(dims)))), index, s).values()))
        parts = index.parts if isinstance(index, Tup) else index if isinstance(index, tuple) else (index,)
        if len(parts) != len(dims):
            raise LoweringError(f"an index of {len(parts)} parts for {len(dims)} dimensions")
        unique = s.key is not None and {s.top(n) for n in s.key} <= {s.top(n) for p in parts for n in self._plain(p)}
        df = s.df.select(*[column(p).alias(f"i{k}") for k, p in enumerate(parts)], column(v).alias("v"))
        tops = [s.top(p.name) if isinstance(p, Col) and p.name else None for p in parts]
        full = unique and s.covers and len(set(tops)) == len(dims) and all(s.domains.get(n) == d for n, d in zip(tops, dims, strict=True))
        return store(df, dims, dense, unique=unique, full=full)

    def _nested(self, e: t.TensorOf, dims: list, s: State) -> Any:
        """An array inside a value: dense of one dimension as an ARRAY, any other as an array of (index, value)."""
        pairs = self.value(e.of, s) if not isinstance(e.of, t.Comprehension) else None
        if isinstance(e.of, t.Comprehension):
            pairs = self._in_row(e.of, s)
            if pairs is None:
                raise LoweringError("an array in a value is made from one array")
        return self._placed(column(pairs), dims, e, s)

    def _placed(self, pairs: Column, dims: list, e: t.TensorOf, s: State) -> Any:
        if len(dims) != 1 or e.sparse:
            return Col(F.sort_array(pairs))
        kind = self.kind(Col(pairs), s).elementType
        value = kind.fields[1].dataType
        by = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p.getField(kind.fields[0].name).cast("bigint").alias("k"), p.getField(kind.fields[1].name).alias("v"))))
        made = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(int(dims[0]) - 1).cast("bigint")), lambda k: F.coalesce(F.try_element_at(by, k), zero(value)))
        return Col(made)


def cast(v: Any, kind: str) -> Any:
    sql = scalars.TYPES.get(kind)
    if sql is None or isinstance(v, (Tensor, DataFrame, list, dict)):
        return v
    if is_row(v):
        return Col(column(v).cast(sql))
    return {"int": int, "bigint": int, "double": float, "float": float, "boolean": bool, "string": str}[sql](v)


def table(df: DataFrame, head: Any) -> DataFrame:
    """Head values as a table: a tuple's parts are _1, _2, ..., a record's its names, any other value ``value``."""
    if isinstance(head, Rec):
        return df.select(*[column(p).alias(n) for n, p in head.parts.items()])
    if isinstance(head, (Tup, tuple)):
        parts = head.parts if isinstance(head, Tup) else head
        return df.select(*[column(Tup(p) if isinstance(p, tuple) else p).alias(f"_{k + 1}") for k, p in enumerate(parts)])
    return df.select(column(head).alias("value"))


def coerce(v: Any, dims: tuple[int, ...], dense: int) -> Tensor:
    """Another storage for an array, or a table of (index, value) as one."""
    if isinstance(v, Tensor):
        cells = v.cells() if dense == len(dims) or not v.is_sparse else v.df
        return store(cells, dims, dense, unique=True, full=v.full and v.dims == dims)
    if isinstance(v, DataFrame):
        first = v.schema[0].dataType
        if len(v.columns) == len(dims) + 1:
            cols = [F.col(c) for c in v.columns]
        elif isinstance(first, T.StructType) and len(first.fields) == len(dims):
            cols = [F.col(v.columns[0]).getField(f.name) for f in first.fields] + [F.col(v.columns[1])]
        else:
            raise LoweringError("an array is built from rows of an index and a value")
        return store(v.select(*[c.alias(f"i{k}") for k, c in enumerate(cols[:-1])], cols[-1].alias("v")), dims, dense, unique=False)
    raise LoweringError(f"no array from {type(v).__name__}")
