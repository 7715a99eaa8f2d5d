"""Programs: statements, and loops as bulk updates.

A loop nest is split: each assignment in it becomes one comprehension over the
loops' ranges and conditions, carried out for all indexes before the next one
starts.  ``while`` runs on the driver; the arrays that its body assigns are written
to the shared folder so that plans do not grow with the rounds.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..lang import tree as t
from ..session import config, materialise
from ..tensor import Tensor, merge, store, zero
from .lower import STORAGES, Closure, Lowering, LoweringError, State, cast, coerce, column, is_row


class LoopError(Exception):
    """A loop that has no bulk form."""


def register_storage(name: str, view, store_) -> None:
    """``view`` makes rows (index, value) of a stored table, ``store_`` a stored table of such rows; both take the
    storage's arguments after the table.  A program then writes ``name(arguments) [ ... ]`` and scans the result."""
    STORAGES[name] = ((), view, store_)


class Program:
    def __init__(self, spark: SparkSession, env: dict[str, Any]):
        self.spark, self.env = spark, env
        self.lower = Lowering(spark, env)
        self.weight: dict[str, int] = {}  # scans in the plan of an array, about
        self.arrays: dict[str, tuple[tuple[int, ...], int]] = {n: (v.dims, v.dense) for n, v in env.items() if isinstance(v, Tensor)}

    def run(self, block: t.Block) -> Any:
        out = None
        for s in block.parts:
            out = self.statement(s)
        return out

    def value(self, e: t.Node) -> Any:
        if isinstance(e, t.Block):
            return self.run(e)
        if isinstance(e, t.Reduce):
            out = self.lower.reduced(e)
            return out.first()[0] if isinstance(out, DataFrame) else out
        if isinstance(e, t.Tuple):
            return tuple(self.value(p) for p in e.parts)
        v = self.lower.value(e, State())
        if is_row(v):  # a function of no row, such as random()
            return self.spark.range(1).select(column(v)).first()[0]
        return v

    def weigh(self, e: Any) -> int:
        """Scans that the plan of an expression makes, about."""
        own = self.weight.get(e.name, 1) if isinstance(e, t.Name) and isinstance(self.env.get(e.name), Tensor) else 0
        return own + sum(self.weigh(c) for c in t.children(e) if isinstance(c, (t.Node, tuple)))

    def settle(self, name: str, weight: int) -> None:
        """Write an array to the shared folder once its plan has grown past ``config.plan_scans`` scans."""
        v = self.env[name]
        if isinstance(v, Tensor) and weight > config.plan_scans:
            self.env[name] = v.with_df(materialise(v.df))
            weight = 1
        self.weight[name] = weight

    def assigned(self, name: str, v: Any) -> None:
        """A name keeps the shape and storage it was declared with."""
        if name in self.arrays and isinstance(v, (Tensor, DataFrame)):
            v = coerce(v, *self.arrays[name])
        elif isinstance(v, Tensor):
            self.arrays[name] = (v.dims, v.dense)
        self.env[name] = v

    def statement(self, s: t.Node) -> Any:
        if isinstance(s, t.Do):
            if isinstance(s.value, t.Call) and s.value.name == "cache" and isinstance(s.value.args[0], t.Name):
                n = s.value.args[0].name
                self.env[n] = self.env[n].persist()
                return self.env[n]
            return self.value(s.value)
        if isinstance(s, t.Block):
            return self.run(s)
        if isinstance(s, t.Var):
            v = self.value(s.value) if s.value is not None else None
            weight = 1 + self.weigh(s.value) if s.value is not None else 1
            self.arrays.pop(s.name, None)
            self.assigned(s.name, cast(v, s.type) if s.type else v)
            self.settle(s.name, weight)
            return None
        if isinstance(s, t.Assign):
            if isinstance(s.target, t.Name):
                weight = 1 + self.weigh(s.value)
                self.assigned(s.target.name, self.value(s.value))
                self.settle(s.target.name, weight)
            elif isinstance(s.target, t.Tuple):
                for n, v in zip(s.target.parts, self.value(s.value), strict=True):
                    self.assigned(n.name, v)
            else:
                self.loop(s, [])
            return None
        if isinstance(s, t.Update):
            if isinstance(s.target, t.Name) and not isinstance(self.env.get(s.target.name), Tensor):
                self.env[s.target.name] = self.value(t.Binary(s.op, s.target, s.value))
            else:
                self.loop(s, [])
            return None
        if isinstance(s, (t.For, t.ForEach)):
            return self.loop(s, [])
        if isinstance(s, t.While):
            rounds = 0
            names = sorted(_assigned(s.body))
            while self.value(s.test):
                self.statement(s.body)
                rounds += 1
                if rounds % config.checkpoint_every == 0:
                    for n in names:
                        v = self.env.get(n)
                        if isinstance(v, Tensor):
                            self.env[n] = v.with_df(materialise(v.df))
                        self.weight[n] = 1
            return None
        if isinstance(s, t.IfDo):
            if self.value(s.test):
                return self.statement(s.yes)
            return self.statement(s.no) if s.no is not None else None
        if isinstance(s, t.Define):
            params = t.PTuple(tuple(map(t.PVar, s.params)))
            self.env[s.name] = Closure(params, _body(s.body), {})
            return None
        if isinstance(s, t.Return):
            return self.value(s.value)
        if isinstance(s, t.TypeMap):
            view, put = Closure(s.view.params, s.view.body, {}), Closure(s.store.params, s.store.body, {})
            STORAGES[s.name] = (s.params, view, put)
            return None
        raise LoweringError(f"{type(s).__name__} is no statement")

    # ---- loops

    def loop(self, s: t.Node, quals: list[t.Node]) -> None:
        if isinstance(s, t.For):
            step = s.step
            self.loop(s.body, [*quals, t.Generator(t.PVar(s.name), t.Range(s.low, s.high, step))])
        elif isinstance(s, t.ForEach):
            self.loop(s.body, [*quals, t.Generator(s.pattern, s.domain)])
        elif isinstance(s, t.Block):
            for x in s.parts:
                if isinstance(x, t.Var) and x.value is not None:
                    quals = [*quals, t.Let(t.PVar(x.name), x.value)]
                else:
                    self.loop(x, quals)
        elif isinstance(s, t.IfDo):
            self.loop(s.yes, [*quals, t.Where(s.test)])
            if s.no is not None:
                self.loop(s.no, [*quals, t.Where(t.Unary("!", s.test))])
        elif isinstance(s, (t.Update, t.Assign)) and isinstance(s.target, t.Part):
            self.component(s.target, s.op if isinstance(s, t.Update) else None, s.value, quals)
        elif isinstance(s, t.Update):
            self.increment(s.target, s.op, s.value, quals)
        elif isinstance(s, t.Assign):
            f = s.value
            if isinstance(f, t.Call) and len(f.args) == 2 and s.target in f.args:
                self.increment(s.target, f.name, f.args[1 - f.args.index(s.target)], quals)
            elif isinstance(f, t.Binary) and f.op in scalars.MONOIDS and f.left == s.target and not _reads(f.right, s.target):
                self.increment(s.target, f.op, f.right, quals)
            else:
                self.update(s.target, f, quals)
        elif isinstance(s, t.Do) and isinstance(s.value, t.Call) and s.value.name == "cache":
            self.statement(s)
        elif isinstance(s, t.Do) and isinstance(s.value, t.Block):
            self.loop(s.value, quals)
        else:
            raise LoopError(f"{type(s).__name__} in a loop")

    def _target(self, target: t.Node, value: t.Node, quals: list[t.Node]) -> tuple[str, tuple]:
        if not isinstance(target, t.Index) or not isinstance(target.of, t.Name) or not isinstance(self.env.get(target.of.name), Tensor):
            raise LoopError("a loop assigns elements of arrays, or adds to scalars")
        name = target.of.name
        loops = {n for q in quals if isinstance(q, t.Generator) for n in t.bound(q.pattern)}
        for a in target.at:
            if not _affine(a, loops):
                raise LoopError(f"the index of {name} is not a linear form of the loops' variables")
        if any(x != target for x in _reads_of(value, name)):
            raise LoopError(f"the loop reads elements of {name} other than the one it assigns")
        return name, target.at

    def update(self, target: t.Node, value: t.Node, quals: list[t.Node]) -> None:
        """A[i] = e: the new elements replace the old ones."""
        name, at = self._target(target, value, quals)
        old: Tensor = self.env[name]
        index = at[0] if len(at) == 1 else t.Tuple(at)
        state, head = self.lower.comprehension(t.Comprehension(t.Tuple((index, value)), tuple(quals)))
        new = self.lower.stored(state, head, old.dims, len(old.dims))
        whole = _covers(quals, at, self, old.dims) and _reads_whole(value, at, old.dims, self.env)
        weight = self.weight.get(name, 1) + self.weigh(value) + sum(map(self.weigh, quals))
        new_cells = new.df.select(*old.index, F.col("v").cast(old.kind).alias("v"))
        if whole:
            self.env[name] = store(new_cells, old.dims, old.dense, unique=True, full=True)
        else:
            self.env[name] = merge(old, new_cells)
        self.settle(name, weight)

    def component(self, target: t.Part, op: str | None, value: t.Node, quals: list[t.Node]) -> None:
        """A[i]#k = e and A[i]#k op= e: one component of a tuple or record is replaced, or combined with the reduction of the new
        values; the other components stay, or are zero where the array held nothing."""
        element, path = _fields(target)
        name, at = self._target(element, value, quals)
        old: Tensor = self.env[name]
        kind, names = old.kind, []
        for k in path:
            if not isinstance(kind, T.StructType):
                raise LoopError(f"an element of {name} has no component {k}")
            f = kind[k] if isinstance(k, str) else kind.fields[k - 1]
            names.append(f.name)
            kind = f.dataType
        place = ".".join(names)
        keys, v = [self.lower.fresh("k") for _ in at], self.lower.fresh("v")
        pattern = t.PVar(keys[0]) if len(at) == 1 else t.PTuple(tuple(map(t.PVar, keys)))
        key = at[0] if len(at) == 1 else t.Tuple(at)
        if op is None:
            body = t.Comprehension(t.Tuple((key, value)), tuple(quals))
        else:
            body = t.Comprehension(t.Tuple((t.as_expression(pattern), t.Reduce(op, t.Name(v)))), (*quals, t.Let(t.PVar(v), value), t.GroupBy(pattern, key)))
        state, head = self.lower.comprehension(body)
        new = self.lower.stored(state, head, old.dims, len(old.dims)).df.select(*old.index, F.col("v").alias("w"))
        base = old if old.is_sparse or old.full else old.with_df(old.all_cells(), True)
        fold = (lambda a, b: b) if op is None else scalars.MONOIDS[op][1] if op in scalars.MONOIDS else self.lower._function(op)
        whole = F.coalesce("v", zero(old.kind))
        part = whole
        for n in names:
            part = part.getField(n)
        made = F.when(F.col("w").isNull(), F.col("v")).otherwise(whole.withField(place, fold(part, F.col("w")).cast(kind)))
        both = base.df.join(new, old.index, "full_outer").select(*old.index, made.alias("v"))
        self.env[name] = old.with_df(both, base.full)
        self.settle(name, self.weight.get(name, 1) + self.weigh(value) + sum(map(self.weigh, quals)))

    def increment(self, target: t.Node, op: str, value: t.Node, quals: list[t.Node]) -> None:
        """A[i] op= e: reduced by index, then combined with the old elements; a scalar takes the total."""
        user = None if op in scalars.MONOIDS else self.lower._function(op)
        if isinstance(target, t.Name):
            total = self.value(t.Reduce(op, t.Comprehension(value, tuple(quals))))
            old = self.env[target.name]
            if total is not None:
                fold = scalars.MONOIDS[op][3] if user is None else user
                self.env[target.name] = fold(old, total)
            return
        name, at = self._target(target, value, quals)
        old = self.env[name]
        keys = [self.lower.fresh("k") for _ in at]
        v = self.lower.fresh("v")
        pattern = t.PVar(keys[0]) if len(at) == 1 else t.PTuple(tuple(map(t.PVar, keys)))
        key = at[0] if len(at) == 1 else t.Tuple(at)
        body = t.Comprehension(t.Tuple((t.as_expression(pattern), t.Reduce(op, t.Name(v)))), (*quals, t.Let(t.PVar(v), value), t.GroupBy(pattern, key)))
        state, head = self.lower.comprehension(body)
        new = self.lower.stored(state, head, old.dims, len(old.dims))
        fold = scalars.MONOIDS[op][1] if user is None else user
        base = old if old.is_sparse or old.full else old.with_df(old.all_cells(), True)
        weight = self.weight.get(name, 1) + self.weigh(value) + sum(map(self.weigh, quals))
        self.env[name] = merge(base, new.df, fold)
        self.settle(name, weight)


def _fields(target: t.Node) -> tuple[t.Node, list]:
    """The element that a path of parts begins at, and the path."""
    path = []
    while isinstance(target, t.Part):
        path.insert(0, target.key)
        target = target.of
    return target, path


def _body(s: t.Node) -> t.Node:
    """The expression that a definition's statement stands for: what is assigned is put in where it is read later."""
    if isinstance(s, t.Block) and s.parts:
        return _sequence(list(s.parts), {})
    if isinstance(s, (t.Do, t.Return)):
        return s.value
    if isinstance(s, t.IfDo) and s.no is not None:
        return t.If(s.test, _body(s.yes), _body(s.no))
    raise LoweringError("a definition's body is one expression")


def _sequence(parts: list[t.Node], known: dict[str, t.Node]) -> t.Node:
    first, rest = parts[0], parts[1:]
    if not rest or isinstance(first, t.Return):
        return t.substitute(_body(first), known)
    if isinstance(first, t.Var) and first.value is not None:
        value = t.substitute(first.value, known)
        return _sequence(rest, {**known, first.name: t.Cast(value, first.type) if first.type else value})
    if isinstance(first, t.Assign) and isinstance(first.target, t.Name):
        return _sequence(rest, {**known, first.target.name: t.substitute(first.value, known)})
    if isinstance(first, t.Update) and isinstance(first.target, t.Name):
        return _sequence(rest, {**known, first.target.name: t.substitute(t.Binary(first.op, first.target, first.value), known)})
    if isinstance(first, t.IfDo):
        test = t.substitute(first.test, known)
        yes = _sequence([*_parts(first.yes), *rest], known)
        return t.If(test, yes, _sequence([*(_parts(first.no) if first.no is not None else []), *rest], known))
    raise LoweringError(f"{type(first).__name__} in a definition")


def _parts(s: t.Node) -> list[t.Node]:
    return list(s.parts) if isinstance(s, t.Block) else [s]


def _assigned(s: Any) -> set[str]:
    out: set[str] = set()
    if isinstance(s, (t.Assign, t.Update)):
        n = s.target
        while isinstance(n, (t.Index, t.Part)):
            n = n.of
        if isinstance(n, t.Name):
            out.add(n.name)
    if isinstance(s, t.Var):
        out.add(s.name)
    for c in t.children(s):
        if isinstance(c, (t.Node, tuple)):
            out |= _assigned(c)
    return out


def _reads_of(e: Any, name: str) -> list[t.Index]:
    out = [e] if isinstance(e, t.Index) and e.of == t.Name(name) else []
    for c in t.children(e):
        if isinstance(c, (t.Node, tuple)):
            out += _reads_of(c, name)
    return out


def _reads(e: Any, target: t.Node) -> bool:
    return e == target or any(_reads(c, target) for c in t.children(e) if isinstance(c, (t.Node, tuple)))


def _affine(e: t.Node, loops: set[str]) -> bool:
    """c0 + c1 i1 + ... with coefficients free of the loops' variables."""
    if not t.free(e) & loops or isinstance(e, t.Name):
        return True
    if isinstance(e, t.Binary) and e.op in "+-":
        return _affine(e.left, loops) and _affine(e.right, loops)
    if isinstance(e, t.Binary) and e.op == "*":
        a, b = t.free(e.left) & loops, t.free(e.right) & loops
        return not (a and b) and _affine(e.left, loops) and _affine(e.right, loops)
    if isinstance(e, t.Unary):
        return _affine(e.of, loops)
    # a remainder or a quotient by a constant keeps one destination for each index
    return isinstance(e, t.Binary) and e.op in "%/" and not t.free(e.right) & loops and _affine(e.left, loops)


def _covers(quals: list[t.Node], at: tuple, p: Program, dims: tuple[int, ...]) -> bool:
    """Whether the loops assign every index once: a range over each dimension and nothing else."""
    if len(quals) != len(at) or not all(isinstance(q, t.Generator) and isinstance(q.domain, t.Range) and q.domain.step == t.Const(1) for q in quals):
        return False
    ranges = {}
    for q in quals:
        low, high = p.value(q.domain.low) if not t.free(q.domain.low) & set(ranges) else None, p.value(q.domain.high) if not t.free(q.domain.high) & set(ranges) else None
        ranges[q.pattern.name] = (low, high)
    return all(isinstance(a, t.Name) and ranges.get(a.name) == (0, d - 1) for a, d in zip(at, dims, strict=True))


def _reads_whole(e: Any, at: tuple, dims: tuple[int, ...], env: dict[str, Any]) -> bool:
    """Whether an expression has a value wherever the loops go: it reads dense arrays alone, at the loops' own indexes.  A read
    of a sparse array or of a map, or out of an array's range, gives no row, and what was there stays."""
    if isinstance(e, (t.Comprehension, t.Lambda)):
        return False
    if isinstance(e, t.Index) and isinstance(e.of, t.Name) and isinstance(v := env.get(e.of.name), (Tensor, DataFrame)):
        sizes = dict(zip(at, dims, strict=True))
        return isinstance(v, Tensor) and not v.is_sparse and len(e.at) == v.rank and all(sizes.get(a, d + 1) <= d for a, d in zip(e.at, v.dims, strict=True))
    return all(_reads_whole(c, at, dims, env) for c in t.children(e) if isinstance(c, (t.Node, tuple)))
