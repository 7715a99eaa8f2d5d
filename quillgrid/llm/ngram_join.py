"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets with Jaccard similarity t or more share at least l of the first
n - ceil(t n) + l tokens under *any* global order of the tokens (n: the set's size,
l: the smaller of the two sets' demands).  Three orders are used:

1.  frequent shingles last, then by hash.  Its prefixes are joined by token.  Lists
    of up to ``small`` sets give their pairs, and a pair must meet in l lists.
    Longer lists give only links to a hub (their smallest set), and the set of
    members by hub, a family, is settled later.
2.  and 3. two fixed permutations.  Every candidate of the first order from short
    lists and hubs must have l tokens in common under both, and a family's member
    l tokens under the second with a member of another component: they meet by these
    prefixes alone, of 24 bits a token, and only sets that are left are dealt whole.

Which shingles count as frequent comes from all texts, but changes only the order
and never the result: each task counts its own, and the ``hot`` most frequent sums
are sent to all tasks.

Equal sets are one member of the join.  Links found so far make components.  In a
family with more than one component, the members outside its largest one (the
outliers) are then set against all members, in blocks of ``block``: a link between two
components always has an outlier.  No group is expanded into pairs of rows and none
is held whole by a task.  Blocks find the same members' links again and again, so what they find is thinned to
spanning forests before it is joined with anything.

Overlaps are counted on 32 bits of each shingle's hash, which never loses a link; a
link that would not hold with ``doubt`` common shingles less is counted again on all 64 bits.
Of the doubtful links that a block finds, those follow that join what its other links leave apart: a
spanning forest, never its pairs.  Where one of them is refuted, the families are settled again without it.

Defined results: a null or empty text, or one without words, has an empty set and
links with nothing; fewer words than ``k`` make one shingle; repeated rows and equal
sets share a class; a row with a null id is no member of the join and has the class
of the sets equal to its own, else null; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, forest
from .shared import Words, bounded_batches, mix, shingle_set, stage, text_chunks, unstage, window_hashes

ORDERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


@dataclass(frozen=True)
class Threshold:
    """Similarity num / den, and the shingles' length."""

    num: int = 80
    den: int = 100
    k: int = 5

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1

    def demand(self, n):
        return 1 + n // 25

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, to, data, offsets in text_chunks(column):
        w = Words(data, offsets)
        windows = window_hashes(w.hashes, k)
        for i in range(to - at):
            yield at + i, shingle_set(w.hashes, windows, int(w.bounds[i]), int(w.bounds[i + 1]), k)


def _signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---------------------------------------------------------------- passes over the texts


def measure(docs: DataFrame, limit: Threshold, *, repeats: int = 3, buffer: int = 1 << 22) -> DataFrame:
    """Staged: (id, sig, n) of every row, and (token, seen) of the shingles that a task
    meets ``repeats`` times in the part of the sets that a prefix can reach."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, id_type, known = 0, None, set()

        def counted() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, seen = token[seen >= repeats], seen[seen >= repeats]
            none = lambda t: pa.nulls(len(token), t)
            return pa.RecordBatch.from_arrays([none(id_type), none(pa.int64()), none(pa.int64()), _signed(token), pa.array(seen)], names=["id", "sig", "n", "token", "seen"])

        for b in batches:
            id_type = b.schema.field(0).type
            sig, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, s in _sets(b.column(1), limit.k):
                n[i] = len(s)
                sig[i] = _signature(s) if len(s) else 0
                if len(s) and sig[i] not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known.add(int(sig[i]))
                    part = s[: len(s) * 35 // 100 + 2]
                    held.append(part)
                    size += len(part)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sig, mask=n == 0), pa.array(n), pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], names=["id", "sig", "n", "token", "seen"]
            )
            if size > buffer:
                yield counted()
                held.clear()
                size = 0
        if held:
            yield counted()

    return stage(docs.select("id", "text").mapInArrow(run, f"id {kind}, sig long, n long, token long, seen long"), "sets")


def frequent(measured: DataFrame, hot: int) -> np.ndarray:
    """Hashes of the ``hot`` most frequent shingles, sorted."""
    rows = measured.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter("seen >= 8").orderBy(F.desc("seen"), "token").limit(hot).select("token").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _is_in(s: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(s), bool)
    at = np.searchsorted(sorted_values, s)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == s


def postings(docs: DataFrame, limit: Threshold, frequent: np.ndarray, *, hot: bool) -> DataFrame:
    """(token, sig, n) of the prefixes under the first order; only frequent tokens, or only the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            token, sig, n = [], [], []
            for _, s in _sets(b.column(0), limit.k):
                if not len(s):
                    continue
                g = _signature(s)
                if g in known:  # a set that this task has given already
                    continue
                if len(known) > 200_000:
                    known.clear()
                known.add(g)
                size = limit.prefix(len(s)) + limit.demand(len(s)) - 1
                common = _is_in(s, frequent)
                p = s[~common][:size]
                if hot:
                    p = s[common][: size - len(p)]
                token.append(p)
                sig.append(np.full(len(p), g))
                n.append(np.full(len(p), len(s)))
            if token:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(token)), pa.array(np.concatenate(sig).astype(np.int64)), pa.array(np.concatenate(n).astype(np.int32))], names=["token", "sig", "n"])

    return docs.select("text").mapInArrow(run, "token long, sig long, n int")


def marks(sigs: DataFrame, most: int, largest: int = 1 << 26) -> np.ndarray:
    """A bit for each of up to ``most`` sets, in 64-bit words by the lower bits of the signature: 3 % of the others share one
    of them.  With more sets than ``largest`` has room for, more of the others pass, but no set is lost."""
    size = min(largest, max(1 << 10, 1 << (32 * most).bit_length()))
    rows = sigs.groupBy(F.expr(f"cast(shiftright(sig & {size - 1}, 6) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(sig & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def set_parts(docs: DataFrame, limit: Threshold, marked: np.ndarray, *columns: str) -> DataFrame:
    """(id, sig, columns as bytes) of the rows whose sets have their bit in ``marked``: "whole" and "set" are each shingle's
    hash and its upper 32 bits, in order, "second" and "third" the packed prefixes under these orders.  Of the rows with one
    set that a task has met, only those with a smaller id than all before follow."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for rows in batches:
            for at in range(0, rows.num_rows, 1024):
                b = rows.slice(at, 1024)
                where: list[int] = []
                sig: list[int] = []
                made: list[list[bytes]] = [[] for _ in columns]
                for i, s in _sets(b.column(1), limit.k):
                    g = _signature(s) if len(s) else 0
                    if not len(s) or not int(marked[g >> 6 & len(marked) - 1]) >> (g & 63) & 1:
                        continue
                    own = b.column(0)[i].as_py()
                    if own is None or g in least and least[g] <= own:
                        continue
                    if len(least) > 200_000:
                        least.clear()
                    least[g] = own
                    where.append(i)
                    sig.append(g)
                    high = (s >> np.uint64(32)).astype(np.uint32)
                    for column, name in zip(made, columns, strict=True):
                        column.append(s.tobytes() if name == "whole" else high.tobytes() if name == "set" else _packed(high, ORDERS[name == "third"], limit))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where, pa.int64())), pa.array(sig, pa.int64()), *(pa.array(c, pa.binary()) for c in made)], names=["id", "sig", *columns])

    return docs.select("id", "text").mapInArrow(run, ", ".join([f"id {kind}, sig long", *(f"{c} binary" for c in columns)]))


def staged_parts(docs: DataFrame, names: DataFrame, sigs: DataFrame, most: int, limit: Threshold, *columns: str) -> DataFrame:
    """Staged: (sig, columns), one row for each of the sets ``sigs``, of which there are up to ``most``.  Sets that are not
    asked for, most of them, are not dealt at all."""
    of_sigs = sigs.join(names, "sig")
    # one row a set, even if a row is repeated; the rows of an id are in one partition already
    parts = set_parts(docs, limit, marks(sigs, most), *columns).join(of_sigs, ["id", "sig"]).dropDuplicates(["id", "sig"]).drop("id")
    return stage(parts, "set-parts")


# ---------------------------------------------------------------- candidates


def _lists(limit: Threshold, small: int):
    """Postings in order of token and set, as pairs (need > 0) and family members (need = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)  # of the last token, of which more may come
        hub: tuple | None = None  # token, set and size of a long list that has begun

        def out(a, b, need, met, n_a, n_b) -> pa.RecordBatch:
            if len(a):
                key = np.stack([a, b, need, n_a, n_b])
                key, at = np.unique(key, axis=1, return_inverse=True)
                met = np.bincount(at.ravel(), met, key.shape[1]).astype(np.int64)
                a, b, need, n_a, n_b = key
            return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (a, b, need, met, n_a, n_b))], names=["a", "b", "need", "met", "n_a", "n_b"])

        def work(x: np.ndarray, final: bool) -> pa.RecordBatch | None:
            nonlocal rest, hub
            x = np.concatenate([rest, x], axis=1)
            if not x.shape[1]:
                return None
            fresh = np.ones(x.shape[1], bool)
            fresh[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
            x = x[:, fresh]
            starts = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
            counts = np.diff(np.append(starts, x.shape[1]))
            parts: list[tuple] = []

            def family(of: tuple, sig: np.ndarray, n: np.ndarray) -> None:
                parts.append((np.full(len(sig), of[1]), sig, np.zeros(len(sig), int), np.ones(len(sig), int), np.full(len(sig), of[2]), n))

            if hub is not None and x[0, 0] == hub[0]:
                c = counts[0]
                family(hub, x[1, :c], x[2, :c])
                last = x[:, c - 1 : c] if len(starts) == 1 and not final else None
                x, starts, counts = x[:, c:], starts[1:] - c, counts[1:]
                if last is not None:
                    rest = last
                    return out(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            hub = None
            rest = np.zeros((3, 0), np.int64)
            if len(starts) and not final:
                s = starts[-1]
                if counts[-1] > small:
                    hub = (x[0, s], x[1, s], x[2, s])
                    family(hub, x[1, s:], x[2, s:])
                    rest = x[:, -1:]
                else:
                    rest = x[:, s:]
                starts, counts = starts[:-1], counts[:-1]
            for c in np.unique(counts[(counts > 1) & (counts <= small)]):
                rows = starts[counts == c][:, None] + np.arange(c)
                i, j = np.triu_indices(c, 1)
                a, b = rows[:, i].ravel(), rows[:, j].ravel()
                fit = limit.sizes_fit(x[2, a], x[2, b])
                a, b = a[fit], b[fit]
                need = np.minimum(limit.demand(x[2, a]), limit.demand(x[2, b]))
                parts.append((x[1, a], x[1, b], need, np.ones(len(a), int), x[2, a], x[2, b]))
            for s, c in zip(starts[counts > small], counts[counts > small], strict=True):
                family((x[0, s], x[1, s], x[2, s]), x[1, s : s + c], x[2, s : s + c])
            return out(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else None

        for b in batches:
            if (made := work(np.stack([c.to_numpy().astype(np.int64) for c in b.columns]), False)) is not None:
                yield made
        if (made := work(np.zeros((3, 0), np.int64), True)) is not None:
            yield made

    return run


def candidates(docs: DataFrame, limit: Threshold, often: np.ndarray, small: int) -> tuple[DataFrame, DataFrame]:
    """Staged: pairs (a, b) of sets to check, and families (hub, sig, n, n_hub) of the long lists."""
    spark = docs.sparkSession
    shape = "a long, b long, need long, met long, n_a long, n_b long"
    listed = postings(docs, limit, often, hot=False)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stage(listed.repartition(parts, "token").sortWithinPartitions("token", "sig").mapInArrow(_lists(limit, small), shape), "candidates")
    # Lists of frequent shingles: their hubs (one row a shingle, as many as ``often`` has) go to all tasks.
    hot = stage(postings(docs, limit, often, hot=True), "frequent")
    hubs = hot.groupBy("token").agg(F.min(F.struct("sig", "n")).alias("h"))
    of_hot = hot.join(F.broadcast(hubs), "token").select(F.col("h.sig").alias("a"), F.col("sig").alias("b"), F.col("h.n").cast("long").alias("n_a"), F.col("n").cast("long").alias("n_b"))
    members = found.filter("need = 0").select("a", "b", "n_a", "n_b").unionAll(of_hot).distinct()
    families = stage(members.select(F.col("a").alias("hub"), F.col("b").alias("sig"), F.col("n_b").alias("n"), F.col("n_a").alias("n_hub")), "families")
    small_pairs = found.filter("need > 0").groupBy("a", "b").agg(F.sum("met").alias("met"), F.first("need").alias("need")).filter("met >= need").select("a", "b")
    fit = f"hub <> sig and {limit.den} * least(n, n_hub) >= {limit.num} * greatest(n, n_hub)"
    to_hub = families.filter(fit).select(F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b"))
    pairs = stage(small_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(to_hub).distinct(), "pairs")
    return pairs, families


# ---------------------------------------------------------------- verification


def _prefix(s: np.ndarray, order: np.uint32, limit: Threshold) -> np.ndarray:
    """Sorted keys of a set's prefix under an order: linked sets have the smaller one's demand in common."""
    key = s * order
    size = min(len(s), int(limit.prefix(len(s)) + limit.demand(len(s))) + 1)  # two more, for equal bits of two shingles
    return np.sort(np.partition(key, size - 1)[:size])


def _packed(s: np.ndarray, order: np.uint32, limit: Threshold) -> bytes:
    """A set's size and the upper 24 bits of its prefix's keys: fewer bits may make more tokens common, never fewer."""
    keys = (_prefix(s, order, limit) >> np.uint32(8)).astype("<u4")
    return len(s).to_bytes(4, "little") + keys.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes) -> tuple[int, np.ndarray]:
    """Size and keys of ``_packed``."""
    raw = np.frombuffer(data, np.uint8, offset=4).reshape(-1, 3)
    keys = np.zeros((len(raw), 4), np.uint8)
    keys[:, :3] = raw
    return int.from_bytes(data[:4], "little"), keys.view("<u4").ravel()


def _marked(sets: DataFrame, sigs: DataFrame) -> DataFrame:
    """``sets`` without most of those that are not in ``sigs`` (staged), before they are dealt."""
    bits = marks(sigs.select("sig"), sigs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = b.column(0).to_numpy()
            yield b.filter(pa.array((bits[g >> 6 & len(bits) - 1] >> (g & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return sets.mapInArrow(run, sets.schema)


def _sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both sides' sets, a's first."""
    left = sets.select(F.col("sig").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = sets.select(F.col("sig").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(right, "b").join(left, "a").select("a", "b", *[f"{c}_a" for c in columns], *[f"{c}_b" for c in columns])


def _filtered(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs that have the smaller demand in common under the second and under the third order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                (n_a, a2), (_, a3), (n_b, b2), (_, b3) = (_unpacked(batch.column(c)[k].as_py()) for c in range(2, 6))
                need = min(limit.demand(n_a), limit.demand(n_b))
                if limit.sizes_fit(n_a, n_b) and _is_in(b2, a2).sum() >= need and _is_in(b3, a3).sum() >= need:
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select([0, 1])

    return _sides(pairs, sets, "second", "third").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, limit: Threshold, doubt: int = 3) -> DataFrame:
    """(a, b, sure) of the pairs that are linked by 32 bits of their shingles; not sure: counted again by ``confirm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sure = [], []
            for k in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[k].as_py(), np.uint32) for c in (2, 3))
                common = int(_is_in(t, s).sum())
                if limit.linked(common, len(s), len(t)):
                    keep.append(k)
                    sure.append(bool(limit.linked(common - doubt, len(s), len(t))))
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])

    left = stage(_filtered(pairs, sets, limit), "pairs")
    few = _marked(sets.select("sig", "set"), left.select(F.explode(F.array("a", "b")).alias("sig")))
    return _sides(left, few, "set").mapInArrow(run, "a long, b long, sure boolean")


def confirm(found: DataFrame, docs: DataFrame, names: DataFrame, limit: Threshold) -> DataFrame:
    """Staged: the links (a, b, holds) of ``found`` (staged), those that are not sure by all 64 bits, which a pass of its own reads for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds = []
            for k in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (2, 3))
                holds.append(bool(limit.linked(int(_is_in(t, s).sum()), len(s), len(t))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(holds, pa.bool_())], names=["a", "b", "holds"])

    doubtful = found.filter("not sure").select("a", "b").distinct()
    if not (n := doubtful.count()):
        return found.withColumnRenamed("sure", "holds")
    whole = staged_parts(docs, names, doubtful.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), 2 * n, limit, "whole")
    links = stage(found.filter("sure").select("a", "b", F.lit(True).alias("holds")).unionAll(_sides(doubtful, whole, "whole").mapInArrow(run, "a long, b long, holds boolean")), "confirmed")
    unstage(whole)
    return links


def settle(families: DataFrame, roots: DataFrame, sets: DataFrame, limit: Threshold, block: int, doubt: int = 3, refuted: frozenset = frozenset()) -> DataFrame:
    """Links (a, b, sure) between members of one family that are in different components so far, the ``refuted`` ones left out.

    The outliers of a family, its members outside the largest component, are dealt in blocks, and so are all
    members; a block of outliers meets each block of members in a task, first by their prefixes under the second order.
    Those that meet one of another component there are dealt once more, whole, and the task drops members without a token
    in common with any of the outliers under both orders.  What travels is members times blocks of outliers.
    """
    rooted = families.select("hub", "sig").join(roots, families["sig"] == roots["node"]).select("hub", "sig", "root")
    sizes = rooted.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"))
    torn = sizes.groupBy("hub").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("members"), F.max("n").alias("most")).filter("members > most")
    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    torn = torn.withColumn("others", F.col("members") - F.col("most")).select(F.struct(F.col("hub").alias("k")).alias("key"), "largest", cut("members").alias("blocks"), cut("others").alias("outer"))
    open_members = rooted.withColumn("key", F.struct(F.col("hub").alias("k"))).join(torn, "key").withColumns(
        {"own": F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"), "out": F.when(F.col("root") != F.col("largest"), F.pmod(F.xxhash64("sig", F.lit(1)), F.col("outer")).cast("int"))}
    )
    asked = open_members.filter("out is not null").select("hub", "sig", "root", "out", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.lit(True).alias("asks"))
    told = open_members.select("hub", "sig", "root", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("out"), "own", F.lit(False).alias("asks"))
    parts = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(asked.unionByName(told), "dealt")

    def loaded(dealt: DataFrame, column: str) -> DataFrame:
        rows = dealt.join(_marked(sets.select("sig", column), dealt), "sig").select("hub", "out", "own", "sig", "root", "asks", column)
        return rows.repartition(parts, "hub", "out", "own").sortWithinPartitions("hub", "out", "own", F.desc("asks"), "sig")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, shape = None, [], None

        def met() -> pa.RecordBatch:
            kept = [(*group, *held[k][:3]) for k in _meeting(held, limit)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], f.type) for c, f in enumerate(shape)], names=[f.name for f in shape])

        for batch in batches:
            shape = [batch.schema.field(c) for c in range(6)]
            for hub, out, own, sig, root, asks, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub, out, own) != group:
                    if held:
                        yield met()
                    group, held = (hub, out, own), []
                held.append((sig, root, asks, *_unpacked(data)))
        if held:
            yield met()

    by_prefix = loaded(dealt, "second")
    whole = loaded(stage(by_prefix.mapInArrow(meet, T.StructType(by_prefix.schema.fields[:6])), "met"), "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def links() -> pa.RecordBatch:
            a, b, sure = _across(held, limit, doubt, refuted)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])

        for batch in batches:
            for hub, out, own, sig, root, asks, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub, out, own) != group:
                    if held:
                        yield links()
                    group, held = (hub, out, own), []
                held.append((sig, root, asks, np.frombuffer(data, np.uint32)))
        if held:
            yield links()

    return whole.mapInArrow(run, "a long, b long, sure boolean")


def _meeting(members: list, limit: Threshold) -> list[int]:
    """Of a block's members (set, root, asks, size, prefix), those that ask first, which of them may be linked with one of another
    component: as many tokens are common to both prefixes as the smaller demand."""
    n = sum(m[2] for m in members)
    if not n or n == len(members):
        return []
    code = {r: k for k, r in enumerate({m[1] for m in members})}
    root = np.array([code[m[1]] for m in members])
    sizes = np.array([m[3] for m in members])
    token, owner = np.concatenate([m[4] for m in members[:n]]), np.repeat(np.arange(n), [len(m[4]) for m in members[:n]])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    met = np.zeros(len(members), bool)
    for k in range(n, len(members)):
        lo, hi = np.searchsorted(token, members[k][4]), np.searchsorted(token, members[k][4], "right")
        many = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        common = np.bincount(owner[at], minlength=n)
        need = np.minimum(limit.demand(sizes[:n]), limit.demand(sizes[k]))
        hit = (common >= need) & limit.sizes_fit(sizes[:n], sizes[k]) & (root[:n] != root[k])
        met[k] = hit.any()
        met[:n] |= hit
    return np.flatnonzero(met).tolist()


def _across(members: list, limit: Threshold, doubt: int, refuted: frozenset = frozenset()) -> tuple[list[int], list[int], list[bool]]:
    """Links of the outliers (those that ask, first in the list) with members of other components, found with an index from
    shingles to outliers.  A member is looked up only if it has a token in common with an outlier under both orders.

    Sure links and then doubtful ones that are not refuted, as a forest: one less than the components at most."""
    outer = [m for m in members if m[2]]
    if not outer:
        return [], [], []
    up = {m[1]: m[1] for m in members}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    sizes = np.array([len(m[3]) for m in outer])
    token, owner = np.concatenate([m[3] for m in outer]), np.repeat(np.arange(len(outer)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    prefixes = [np.unique(np.concatenate([_prefix(m[3], o, limit) for m in outer])) for o in ORDERS]
    a, b, sure = [], [], []
    doubtful: list[tuple] = []  # of one block, so no more than its pairs
    for sig, root, _, s in members[len(outer) :]:
        if not all(_is_in(_prefix(s, o, limit), p).any() for o, p in zip(ORDERS, prefixes, strict=True)):
            continue
        lo, hi = np.searchsorted(token, s), np.searchsorted(token, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(outer))
        for j in np.flatnonzero(limit.linked(common, sizes, len(s)) & limit.sizes_fit(sizes, len(s))):
            r, q = top(root), top(outer[j][1])
            if r == q:
                continue
            if not limit.linked(int(common[j]) - doubt, int(sizes[j]), len(s)):
                doubtful.append((sig, outer[j][0], root, outer[j][1]))
                continue
            up[r] = q
            a.append(sig)
            b.append(outer[j][0])
            sure.append(True)
    for sig, other, root, outer_root in doubtful:  # last, as none of them must keep a sure one out
        r, q = top(root), top(outer_root)
        if r != q and (min(sig, other), max(sig, other)) not in refuted:
            up[r] = q
            a.append(sig)
            b.append(other)
            sure.append(False)
    return a, b, sure


# ---------------------------------------------------------------- the join


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: Threshold | None = None, small: int = 24, hot: int = 1 << 17, block: int = 512) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set and its class."""
    with bounded_batches(docs.sparkSession):
        found = _classes(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), limit or Threshold(), small, hot, block)
        return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("class", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: Threshold | None = None, small: int = 24, hot: int = 1 << 17, block: int = 512) -> DataFrame:
    """One row of each class, all columns: of the rows with its smallest id, one whose set is in the class.

    Rows with one id whose sets are of different classes are told apart; of those with one id and one set any one
    stays.  A row with a null id stays, and so does one without words for each id.
    """
    limit = limit or Threshold()
    names = [f"c{n}" for n in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_at, text_at = docs.columns.index(key), docs.columns.index(text)
    with bounded_batches(docs.sparkSession):
        found = _classes(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), limit, small, hot, block)
        kept = found.filter("id is not null and (sig is null or id = class)").select(F.col("id").alias("k_id"), F.coalesce("sig", F.lit(0)).alias("k_sig")).distinct()

        def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sig = np.zeros(b.num_rows, np.int64)
                for i, s in _sets(b.column(text_at), limit.k):
                    sig[i] = _signature(s) if len(s) else 0
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig)], names=[*names, "sig"])

        shape = T.StructType([*plain.schema.fields, T.StructField("sig", T.LongType())])
        rows = plain.mapInArrow(signed, shape)
        here = F.col(names[id_at])
        one = rows.join(kept, (here == F.col("k_id")) & (F.col("sig") == F.col("k_sig")), "left_semi").dropDuplicates([names[id_at], "sig"]).select(*names)
        out = one.unionByName(plain.filter(here.isNull())).toDF(*docs.columns)
        return stage(out, "one-of-each")


def _classes(docs: DataFrame, limit: Threshold, small: int, hot: int, block: int) -> DataFrame:
    """(id, sig, n, class) of every row of ``docs`` (id, text)."""
    measured = measure(docs, limit)
    rows = measured.filter("n is not null").select("id", "sig", "n")
    often = frequent(measured, hot)
    pairs, families = candidates(docs, limit, often, small)
    names = rows.filter("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("id"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).unionAll(families.select("sig")).distinct()
    sets = staged_parts(docs, names, wanted, 2 * pairs.count() + families.count(), limit, "set", "second", "third")
    links = stage(_named(_holding(confirm(stage(verify(pairs, sets, limit), "found"), docs, names, limit)), names), "links")
    roots = stage(components(links, "a", "b"), "roots")
    more = stage(_named(_settled(families, _rooted(names, roots), sets, docs, names, limit, block), names), "links")
    if not more.isEmpty():
        roots = stage(components(links.unionAll(more), "a", "b"), "roots")
    unstage(sets)
    by_sig = _rooted(names, roots).select(F.struct(F.col("node").alias("k")).alias("key"), F.col("root").alias("class"))
    return rows.withColumn("key", F.struct(F.col("sig").alias("k"))).join(by_sig, "key", "left").select("id", "sig", "n", "class")


def _holding(found: DataFrame) -> DataFrame:
    """Links that connect the sets that the confirmed ones of ``found`` connect, not many more than there are such sets."""
    return forest(found.filter("holds").select("a", "b"), "a", "b")


def _settled(families: DataFrame, roots: DataFrame, sets: DataFrame, docs: DataFrame, names: DataFrame, limit: Threshold, block: int) -> DataFrame:
    """Confirmed links of ``settle``, which is done again as long as a doubtful link of a forest does not hold: others that it
    kept out may.  A link is refuted where shingles differ in the lower half of their hashes alone, so the driver holds few."""
    refuted: frozenset = frozenset()
    while True:
        found = confirm(stage(settle(families, roots, sets, limit, block, refuted=refuted), "found"), docs, names, limit)
        wrong = {(min(r), max(r)) for r in found.filter("not holds").select("a", "b").collect()}
        if not wrong - refuted:
            return _holding(found)
        refuted |= wrong


def _named(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links of sets as links of the smallest ids that have them, so that a component's root is its smallest id.

    A hub is in the links of its whole family: the join is by a computed key, so both sides are dealt anew and a set
    with many links is a split join.
    """
    for c in ("a", "b"):
        named = names.select(F.struct(F.col("sig").alias("k")).alias("key"), F.col("id").alias(f"id_{c}"))
        links = links.withColumn("key", F.struct(F.col(c).alias("k"))).join(named, "key").drop("key")
    return links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _rooted(names: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): each named set's component; every join is by a key that no two sets share."""
    return names.join(roots, names["id"] == roots["node"], "left").select(F.col("sig").alias("node"), F.coalesce("root", "id").alias("root"))
