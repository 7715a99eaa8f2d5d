"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a row belongs to the arc of the next
point clockwise of its key's hash.  Shards take no more rows than their capacity:
what an arc brings beyond it continues clockwise to the next shard with room.
Rows of an arc are interchangeable, so only the counts by arc (shards x vnodes
rows at most) are needed to decide how many of them each shard takes; a fold over
those counts gives segments (arc, ranks, shard, first slot), which are joined back.

With ``load_factor`` 1 capacities differ by one at most and sum to the number of
rows, so the shards' row counts do as well.  A higher factor leaves slack, so fewer
rows move when a shard is added.

Defined results: a null key hashes like any value; a null text counts as empty;
repeated rows are told apart by their position in the staged table and spread over
bins; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gapless_rank, stage

CELL_BITS = 12


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) in clockwise order; a shard's points depend on it alone."""
    made = []
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest()
            made.append((int.from_bytes(h, "big", signed=True), s))
    return sorted(made)


def _arc_of(hash_sql: str, points: list[tuple[int, int]]) -> str:
    """SQL for the number of points below the hash, modulo their number: an array of
    ``2**CELL_BITS`` cells holds how many points lie before each and those inside it."""
    cells: list[list[int]] = [[] for _ in range(1 << CELL_BITS)]
    for p, _ in points:
        cells[(p >> (64 - CELL_BITS)) + (1 << (CELL_BITS - 1))].append(p)
    before, total = [], 0
    for c in cells:
        before.append(total)
        total += len(c)
    inside = "from_json('" + str(cells).replace(" ", "") + "', 'array<array<bigint>>')"
    cell = f"cast(shiftright({hash_sql}, {64 - CELL_BITS}) + {1 << (CELL_BITS - 1)} as int)"
    base = "from_json('" + str(before).replace(" ", "") + "', 'array<int>')"
    return f"(get({base}, {cell}) + size(filter(get({inside}, {cell}), p -> p < {hash_sql}))) % {len(points)}"


def plan_segments(counts: DataFrame, points: list[tuple[int, int]], shards: int, load_factor: float) -> DataFrame:
    """Fold the counts (arc, n) in ring order into segments (arc, lo, hi, shard, first)."""
    follow = []
    for a in range(len(points)):
        seen: dict[int, None] = {}
        for k in range(len(points)):
            seen.setdefault(points[(a + k) % len(points)][1])
            if len(seen) == shards:
                break
        follow.append(list(seen))
    orders = "from_json('" + str(follow).replace(" ", "") + "', 'array<array<int>>')"
    segment = "array<struct<arc:int,lo:bigint,hi:bigint,shard:int,first:bigint>>"
    if load_factor <= 1:
        room = f"transform(sequence(0, {shards - 1}), i -> cast(total div {shards} + if(i < total % {shards}, 1, 0) as bigint))"
    else:
        room = f"transform(sequence(0, {shards - 1}), i -> cast(ceil(total * {load_factor!r}D / {shards}) as bigint))"
    step = f"""
      (s, shard) -> named_struct(
        'left', s.left - least(s.left, get(s.free, shard)),
        'at', s.at + least(s.left, get(s.free, shard)),
        'free', if(s.left > 0, transform(s.free, (x, i) -> if(i = shard, x - least(s.left, x), x)), s.free),
        'made', if(least(s.left, get(s.free, shard)) > 0,
                   concat(s.made, array(named_struct('arc', arc.arc, 'lo', s.at, 'hi', s.at + least(s.left, get(s.free, shard)),
                                                     'shard', shard, 'first', get(room, shard) - get(s.free, shard)))),
                   s.made))"""
    fold = f"""
      aggregate(arcs,
        named_struct('free', room, 'made', cast(array() as {segment})),
        (acc, arc) -> aggregate(get({orders}, arc.arc),
            named_struct('left', arc.n, 'at', 0L, 'free', acc.free, 'made', acc.made), {step},
            s -> named_struct('free', s.free, 'made', s.made)),
        acc -> acc.made)"""
    return (
        counts.agg(F.sort_array(F.collect_list(F.struct("arc", "n"))).alias("arcs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        .withColumn("room", F.expr(room))
        .select(F.explode(F.expr(fold)).alias("s"))
        .select("s.*")
    )


def assign_shards(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", vnodes: int = 64, load_factor: float = 1.0, bins: int = 16) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row; slots of a shard run from 0 without gaps.

    The order of rows in an arc is that of their keys' hashes.
    """
    points = ring_points(shards, vnodes)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = stage(
        docs.select(
            F.col(key).alias("key"),
            (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(key).alias("hash"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumns(
            {
                "arc": F.expr(f"cast({_arc_of('hash', points)} as int)"),
                "bin": F.pmod(F.xxhash64("row", "hash"), F.lit(bins)),
            }
        ),
        "shard-keys",
    )
    ranked = gapless_rank(narrow, "arc", ["hash", "key", "row"], bins)
    counts = narrow.groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    segments = plan_segments(counts, points, shards, load_factor)
    return (
        # at most arcs + shards segments
        ranked.join(F.broadcast(segments), (ranked["arc"] == segments["arc"]) & (ranked["rank"] >= segments["lo"]) & (ranked["rank"] < segments["hi"]))
        .select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))
    )
