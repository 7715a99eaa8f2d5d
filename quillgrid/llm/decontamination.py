"""Benchmark decontamination by spaced seeds.

Fixed masks over twelve words leave some positions out, so a substituted word at
such a position does not change a window's hash.  The items' hashes of all masks
are joined with those of every position of every text; each hit names a diagonal
(text position minus item position), on which words are compared one by one.  The
longest stretch of a diagonal of which at least penalty / (1 + penalty) agrees (its sum,
one for an equal word and minus ``penalty`` for a substituted one, is not negative)
and that begins and ends with an equal word, or is the whole item, is an overlap if it
has ``least_words`` words, or all words of a shorter item.

An item of fewer than twelve words is sought as a whole under the same law.  Of n words
n // (1 + penalty) may be substituted, so of one part more, cut in fixed places, one part
is equal: the masks that show a single part find it.

The items' hashes go to every task in blocks of ``block_words`` item words, one
pass over the texts a block, so what is sent is bounded whatever the benchmark's size.
A seed that many items share names them ``EXPANDED`` at a time.

Defined results: a null or empty text or item overlaps nothing; an item of 3 to 11
words is sought as a whole, a shorter one not at all (it would name no source);
overlaps of one text and item that overlap in the text are one, whose matched words
are those of the text that any of them matches; items with one text are
all reported; repeated rows are reported as often; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _SHINGLE, Words, mix, stage, text_chunks

# The masks over twelve words; 1 counts, 0 is left out.
MASKS = ("110110111011", "111010110111", "101111011101", "111101101011", "011011101111", "111111110000")
SPAN = 12
SHORTEST = 3
#: Hits of a chunk that are compared at once.
EXPANDED = 1 << 18


def _parts(n: int, penalty: int) -> list[tuple[int, int]]:
    """(start, words) of the parts of a short item of which one is equal in every overlap."""
    cut = n // (1 + penalty) + 1
    ends = [n * (k + 1) // cut for k in range(cut)]
    return [(a, z - a) for a, z in zip([0, *ends], ends, strict=False)]


def _mask_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(salt * 2 + 1))
    for j, c in enumerate(mask):
        if c == "1":
            total += words[j : j + n] * _SHINGLE[j]
    return mix(total)


class Seeds:
    """Seeds of a block of items, sorted by hash, with a bitmap of their top bits."""

    def __init__(self, items: list[tuple[int, np.ndarray]], penalty: int):
        self.items = items
        short = {n for _, w in items if SHORTEST <= len(w) < SPAN for _, n in _parts(len(w), penalty)}
        self.masks = [*MASKS, *("1" * n for n in sorted(short))]
        salt = {len(mask): m for m, mask in enumerate(self.masks) if m >= len(MASKS)}
        hashes, owner, place = [], [], []

        def add(k: int, h: np.ndarray, at: np.ndarray) -> None:
            hashes.append(h)
            owner.append(np.full(len(h), k))
            place.append(at)

        for k, (_, w) in enumerate(items):
            if len(w) >= SPAN:
                for m, mask in enumerate(MASKS):
                    h = _mask_hashes(w, mask, m)
                    add(k, h, np.arange(len(h)))
            elif len(w) >= SHORTEST:
                for at, n in _parts(len(w), penalty):
                    add(k, _mask_hashes(w[at : at + n], "1" * n, salt[n]), np.array([at]))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        h, o, p = cat(hashes, np.uint64), cat(owner, np.int64), cat(place, np.int64)
        order = np.lexsort((p, o, h))
        self.hash, self.owner, self.place = h[order], o[order], p[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        # the words of short items in rows, for comparisons of many hits at once
        self.size = np.array([len(w) for _, w in items], np.int64)
        self.words = np.zeros((len(items), SPAN), np.uint64)
        for k, (_, w) in enumerate(items):
            if len(w) < SPAN:
                self.words[k, : len(w)] = w

    def _hits(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, diagonal) of the seeds that a chunk has, ``EXPANDED`` hits at a time."""
        for m, mask in enumerate(self.masks):
            h = _mask_hashes(w.hashes, mask, m)
            at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hash, h[at]), np.searchsorted(self.hash, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            text = np.searchsorted(w.bounds, at, "right") - 1
            inside = at + len(mask) <= w.bounds[text + 1]
            at, lo, n, text = at[inside], lo[inside], n[inside], text[inside]
            before = np.concatenate([[0], np.cumsum(n)])
            for begin in range(0, int(before[-1]), EXPANDED):
                hit = np.arange(begin, min(begin + EXPANDED, int(before[-1])))
                row = np.searchsorted(before, hit, "right") - 1
                seed = lo[row] + hit - before[row]
                yield text[row], self.owner[seed], at[row] - self.place[seed]

    def _possible(self, w: Words, each: np.ndarray, penalty: int) -> np.ndarray:
        """Which hits (text, item, diagonal) can be overlaps: short items are compared as wholes here, all at once."""
        text, item, d = each
        n, good = self.size[item], np.ones(len(item), bool)
        short = np.flatnonzero(n < SPAN)
        text, item, d, n = text[short], item[short], d[short], n[short]
        equal = np.zeros(len(short), np.int64)
        for j in range(SPAN):
            at = d + j
            ok = (j < n) & (at >= w.bounds[text]) & (at < w.bounds[text + 1])
            equal += ok & (w.hashes[np.where(ok, at, 0)] == self.words[item, j])
        good[short] = (equal >= penalty * (n - equal)) & (d >= w.bounds[text]) & (d + n <= w.bounds[text + 1])
        return good

    def overlaps(self, w: Words, least: int, penalty: int) -> Iterator[tuple]:
        """(text, item, start, end, item start, item end, matched), words, every stretch of each text and item."""
        kept = []
        for text, item, diagonal in self._hits(w):
            each = np.unique(np.stack([text, item, diagonal]), axis=1)
            kept.append(each[:, self._possible(w, each, penalty)])
        if not kept:
            return
        found: dict[tuple[int, int], list[tuple]] = {}
        for text, k, d in np.unique(np.concatenate(kept, axis=1), axis=1).T.tolist():
            own = self.items[k][1]
            a, z = max(0, int(w.bounds[text]) - d), min(len(own), int(w.bounds[text + 1]) - d)
            equal = w.hashes[d + a : d + z] == own[a:z]
            begin = d + a - int(w.bounds[text])
            for lo, hi in _stretches(equal, penalty, min(least, len(own)), z - a == len(own)):
                found.setdefault((text, k), []).append((begin + lo, begin + hi, a + lo, a + hi, begin + lo + np.flatnonzero(equal[lo:hi])))
        for (text, k), spans in found.items():
            for start, end, first, last, places in _merged(spans):
                yield text, k, start, end, first, last, len(places)


def _merged(spans: list[tuple]) -> Iterator[tuple]:
    """Spans (start, end, item start, item end, equal places) of one text and item, united where they overlap in the text."""
    now: tuple | None = None
    for s in sorted(spans, key=lambda s: s[:4]):
        if now is not None and s[0] < now[1]:
            now = (now[0], max(now[1], s[1]), min(now[2], s[2]), max(now[3], s[3]), np.union1d(now[4], s[4]))
            continue
        if now is not None:
            yield now
        now = s
    if now is not None:
        yield now


def _stretches(equal: np.ndarray, penalty: int, least: int, whole: bool) -> Iterator[tuple[int, int]]:
    """Every stretch of ``least`` words or more: the longest, and those of what lies before and after it."""
    if whole and equal.sum() >= penalty * (~equal).sum():  # the whole item, whatever its outer words
        yield 0, len(equal)
        return
    parts = [(0, len(equal))]
    while parts:
        a, z = parts.pop()
        lo, hi, _ = _stretch(equal[a:z], penalty) if z - a >= least else (0, 0, 0)
        if hi - lo >= max(least, 1):
            yield a + lo, a + hi
            parts += [(a, a + lo), (a + hi, z)]


def _stretch(equal: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """The longest stretch of sum 0 or more, from an equal word to an equal word (the first of equally long ones): start, end, equal words."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -penalty))])
    starts, ends = np.flatnonzero(equal), np.flatnonzero(equal) + 1
    if not len(starts):
        return 0, 0, 0
    # the first start whose sum is no higher than an end's: minima over the starts so far fall, so it is found by bisection
    low = np.minimum.accumulate(sums[starts])
    first = starts[np.searchsorted(-low, -sums[ends])]
    best = int((ends - first).argmax())
    start, end = int(first[best]), int(ends[best])
    return start, end, int(equal[start:end].sum())


def _blocks(benchmark: DataFrame, item: str, item_text: str, block_words: int) -> Iterator[list[tuple]]:
    """The items' ids and word hashes, about ``block_words`` words at a time."""
    sized = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    words = sized.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-words // block_words))
    for n in range(blocks):
        items = []
        for r in sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == n).toLocalIterator():
            data = np.frombuffer(r["text"].encode(), np.uint8)
            items.append((r["item"], Words(data, np.array([0, len(data)])).hashes))
        yield items


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least_words: int = 13, penalty: int = 4, block_words: int = 1_000_000) -> DataFrame:
    """(key, item, start, end, item_start, item_end, matched): offsets in words, ends exclusive."""
    kinds = docs.schema[key].dataType, benchmark.schema[item].dataType
    schema = f"doc {kinds[0].simpleString()}, item {kinds[1].simpleString()}, start long, end long, item_start long, item_end long, matched long"
    parts = [docs.select(F.col(key), F.col(text)).mapInArrow(_pass(items, least_words, penalty), schema) for items in _blocks(benchmark, item, item_text, block_words)]
    if len(parts) > 1:
        parts = [stage(p, "overlaps") for p in parts]
    return reduce(DataFrame.unionAll, parts).withColumnsRenamed({"doc": key, "item": item})


def drop_overlapping(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", least_words: int = 13, penalty: int = 4, block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts overlap no item; no row is shuffled."""
    place = docs.columns.index(text)

    def keep(items: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(items, penalty)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for at, _, data, offsets in text_chunks(b.column(place)):
                    for r in seeds.overlaps(Words(data, offsets), least_words, penalty):
                        clean[at + r[0]] = False
                yield b.filter(pa.array(clean))

        return run

    for items in _blocks(benchmark, item, item_text, block_words):
        docs = docs.mapInArrow(keep(items), docs.schema)
    return docs


def _pass(items: list, least: int, penalty: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(items, penalty)
        for b in batches:
            rows = []
            for at, _, data, offsets in text_chunks(b.column(1)):
                w = Words(data, offsets)
                rows += [(at + r[0], *r[1:]) for r in seeds.overlaps(w, least, penalty)]
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(c[0], pa.int64())), pa.array([items[k][0] for k in c[1]]), *(pa.array(x, pa.int64()) for x in c[2:])],
                    names=["doc", "item", "start", "end", "item_start", "item_end", "matched"],
                )

    return run
