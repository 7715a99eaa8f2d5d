"""Toxicity scores from a lexicon that is matched with misspellings and read in context.

A lexicon of words and word stems is learned from labelled texts, and laid out as a
trie.  The Levenshtein automaton for one edit is intersected with that trie and
made deterministic once; texts then run through its transition table, all words of
a chunk at a time.  Each hit is read in a window of words: hits inside quotation
marks, next to other hits or next to words of address count apart, so that the
logistic model over the counts and their densities can tell quotation from abuse.

Two parameters bound training, and training alone: ``fit`` reads at most ``sample_rows``
labelled texts (those with the smallest hashes of their ids), and the lexicon has at
most ``terms`` entries, the most frequent ones.  Scoring reads whole texts and keeps
nothing between rows.

Defined results: a null or empty text has no hits and gets the score of one; rows
with a null label do not train; an id labelled twice takes its larger label; with no
labelled row of either class every score is the share of toxic labels (0.0 if none);
repeated rows are scored alike; an empty table gives no rows; other columns pass
through, and one named like an output column is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage

# Quotation marks, words of address and the signs that stand for letters inside words.
QUOTES = '"“”„«»'
ADDRESS = ("you", "your", "youre", "u", "ur", "du", "dich", "dein", "ihr", "euch", "sie", "tu", "toi", "te", "vous", "usted", "ustedes", "eres", "are", "bist", "es")
SIGNS = "@$*"
WINDOW = 6
NAMES = ("word", "word_fuzzy", "stem", "stem_fuzzy", "quoted", "addressed", "clustered", "words")

_TOKEN = re.compile(r"[@$*]?[^\W_]+(?:[@$*]+[^\W_]+)*")


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: one fifth, by CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---------------------------------------------------------------- lexicon


def learn_lexicon(texts: list[str], toxic: np.ndarray, *, limit: int = 1_000, support: float = 0.02, precision: float = 0.9, dense: float = 0.008) -> list[tuple[str, bool]]:
    """Words and stems (term, is_stem) that mark toxic texts, the most frequent first.

    A stem is a beginning that at least three different words share; what a chosen
    stem begins is not listed again.  A term marks a text by being in it, or, if it is a
    stem that clean texts also hold now and then, by being the share ``dense`` of its words.
    It must mark the share ``support`` of the toxic texts, and three at least.
    """
    least = max(3, math.ceil(support * toxic.sum()))

    def marks(d: int) -> tuple[Counter, set]:
        """A text's words, and the terms that mark it as (word, is_stem, is_dense)."""
        own = Counter(_TOKEN.findall(texts[d].lower()))  # one text's words at a time are held
        stems: Counter = Counter()
        for w, n in own.items():
            for k in range(4, min(8, len(w))):
                stems[w[:k]] += n
        bar = dense * sum(own.values())
        out = {(w, False, False) for w in own if len(w) >= 4}
        out.update((s, True, False) for s in stems)
        out.update((s, True, True) for s, n in stems.items() if n >= bar and n > 1)
        return own, out

    where: Counter = Counter()
    for d in np.flatnonzero(toxic):
        where.update(marks(d)[1])
    where = Counter({t: n for t, n in where.items() if n >= least})
    stems = {t[0] for t in where if t[1]}
    heads: dict[str, set[str]] = defaultdict(set)  # words that a stem begins, three at most
    for d in np.flatnonzero(toxic):
        for w in marks(d)[0]:
            for n in range(4, min(8, len(w))):
                if w[:n] in stems and len(heads[w[:n]]) < 3:
                    heads[w[:n]].add(w)
    where = Counter({t: n for t, n in where.items() if not t[1] or len(heads[t[0]]) >= 3})
    clean: Counter = Counter()
    for d in np.flatnonzero(~toxic):
        clean.update(t for t in marks(d)[1] if t in where)
    weight = max(1.0, (~toxic).sum() / max(1, toxic.sum()))  # classes weigh alike
    good = [t for t, n in where.items() if n * weight >= precision * (n * weight + 4 * clean[t]) and clean[t] <= 0.1 * n]
    chosen: list[tuple[str, bool]] = []
    for t in sorted(good, key=lambda t: (-where[t], not t[1], len(t[0]), t)):
        if len(chosen) < limit and t[:2] not in chosen and not any(stem and t[0].startswith(s) for s, stem in chosen):
            chosen.append(t[:2])
    return chosen


@dataclass
class Automaton:
    """A deterministic table over classes of code points; ``verdict``: 0 no match, else 1 + index in
    the first four of NAMES."""

    table: np.ndarray
    verdict: np.ndarray
    classes: dict[str, int]


def build_automaton(lexicon: list[tuple[str, bool]]) -> Automaton:
    """Subset construction over (trie node, edits) pairs; words under five letters and
    stems under six allow no edit."""
    children: list[dict[str, int]] = [{}]
    ends: list[set[tuple[bool, int]]] = [set()]
    deep: list[int] = [0]  # most edits that any term below the node allows
    for term, stem in lexicon:
        allowed = int(len(term) >= (6 if stem else 5))
        at = 0
        deep[0] = max(deep[0], allowed)
        for c in term:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                ends.append(set())
                deep.append(0)
            at = children[at][c]
            deep[at] = max(deep[at], allowed)
        ends[at].add((stem, allowed))
    classes = {c: k + 1 for k, c in enumerate(sorted({c for t, _ in lexicon for c in t}))}

    def close(states: set) -> frozenset:
        todo = list(states)
        while todo:
            n, e = todo.pop()
            if isinstance(n, int) and e == 0:
                for m in children[n].values():
                    if deep[m] and (m, 1) not in states:  # a letter of the term is left out
                        states.add((m, 1))
                        todo.append((m, 1))
        out = set()
        for n, e in states:
            out.add((n, e))
            if isinstance(n, int):
                for stem, allowed in ends[n]:
                    if stem and e <= allowed:
                        out.add(("stem", e))
        return frozenset(out)

    def verdict(states: frozenset) -> int:
        found = set()
        for n, e in states:
            if n == "stem":
                found.add(3 + e)
            else:
                found.update((4 if stem else 2) if e else (3 if stem else 1) for stem, allowed in ends[n] if e <= allowed)
        return min(found, key=lambda v: (v % 2 == 0, v)) if found else 0

    start = close({(0, 0)})
    ids, rows, todo = {start: 0}, [], [start]
    while todo:
        states = todo.pop(0)
        row = []
        for c in [None, *classes]:
            after: set = set()
            for n, e in states:
                if n == "stem":
                    after.add((n, e))
                    continue
                if c in children[n]:
                    after.add((children[n][c], e))
                if e == 0:
                    if deep[n]:
                        after.add((n, 1))  # a letter too many
                    after.update((m, 1) for m in children[n].values() if deep[m])  # another letter
            after = close(after)
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
            row.append(ids[after])
        rows.append(row)
    order = sorted(ids, key=ids.get)
    return Automaton(np.array(rows, np.int32), np.array([verdict(s) for s in order], np.int8), classes)


# ---------------------------------------------------------------- features


class Reader:
    """Counts of NAMES for texts, by an automaton."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        space = np.zeros(0x110000, np.uint8)  # 1 letter or digit, 2 sign inside a word
        space[:0x40000] = [chr(c).isalnum() for c in range(0x40000)]
        for c in SIGNS:
            space[ord(c)] = 2
        self.kind = space
        self.quote = np.zeros(0x110000, bool)
        self.quote[[ord(c) for c in QUOTES]] = True
        self.lookup = np.zeros(0x110000, np.uint16 if len(automaton.classes) < 1 << 16 else np.uint32)
        for c, k in automaton.classes.items():
            self.lookup[ord(c)] = k

    def read(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(NAMES)))
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 500_000):
                size += len(texts[to])
                to += 1
            self._chunk(texts[at:to], out[at:to])
            at = to
        return out

    def _chunk(self, texts: list[str], out: np.ndarray) -> None:
        lowered = [t.lower() for t in texts]
        text = " ".join(lowered)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return
        bounds = np.cumsum([0] + [len(t) + 1 for t in lowered])
        kind = self.kind[codes]
        inside = np.concatenate([[False], kind > 0, [False]])
        starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        letter = kind == 1
        place = np.arange(len(codes))
        last = np.maximum.accumulate(np.where(letter, place, -1))
        first = np.minimum.accumulate(np.where(letter, place, len(codes))[::-1])[::-1]
        # a sign right before a word is a letter of it ("$cum"), signs after a word are not
        lead = np.clip(first[starts] - 1, starts, None)
        starts, ends = np.where(first[starts] < ends, lead, ends), last[ends - 1] + 1
        some = ends > starts
        starts, ends = starts[some], ends[some]
        if not len(starts):
            return
        out[:, 7] = np.bincount(np.searchsorted(bounds, starts, "right") - 1, minlength=len(texts))
        table, state = self.automaton.table, np.zeros(len(starts), np.int32)
        cls = self.lookup[codes]
        dead = int(np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (self.automaton.verdict == 0))[0]) if len(self.automaton.classes) else -1
        alive, step = np.arange(len(starts)), 0
        while len(alive):
            alive = alive[starts[alive] + step < ends[alive]]
            state[alive] = now = table[state[alive], cls[starts[alive] + step]]
            alive = alive[now != dead]
            step += 1
        verdict = self.automaton.verdict[state]
        hits = np.flatnonzero(verdict)
        if not len(hits):
            return
        doc = np.searchsorted(bounds, starts[hits], "right") - 1
        np.add.at(out, (doc, verdict[hits] - 1), 1)
        marks = np.concatenate([[0], np.cumsum(self.quote[codes])])
        before = marks[starts[hits]] - marks[bounds[doc]]
        after = marks[np.minimum(bounds[doc + 1], len(codes))] - marks[starts[hits]]
        np.add.at(out[:, 4], doc, (before % 2 == 1) & (after > 0))
        close = np.diff(hits) <= WINDOW
        same = np.diff(doc) == 0
        near = np.concatenate([[False], close & same]) | np.concatenate([close & same, [False]])
        np.add.at(out[:, 6], doc, near)
        for h, d in zip(hits, doc, strict=True):
            for k in range(max(0, h - WINDOW), min(len(starts), h + WINDOW + 1)):
                if bounds[d] <= starts[k] < bounds[d + 1] and text[starts[k] : ends[k]] in _ADDRESS:
                    out[d, 5] += 1
                    break


_ADDRESS = frozenset(ADDRESS)


# ---------------------------------------------------------------- model


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray
    lexicon: list[tuple[str, bool]] = field(default_factory=list)

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(counts) @ self.weights, -30, 30)))


def _design(counts: np.ndarray) -> np.ndarray:
    hits = counts[:, :4].sum(1, keepdims=True)
    shares = counts[:, 4:7] / np.maximum(hits, 1)
    density = np.log1p(1000 * counts[:, :4] / np.maximum(counts[:, 7:8], 20))
    return np.hstack([np.ones((len(counts), 1)), np.log1p(counts[:, :4]), (hits > 0).astype(float), shares, density])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 8_000, terms: int = 1_000) -> Model:
    """Learn from the labelled rows outside the held-out fifth, ``sample_rows`` at most.

    The weights are learned from each half's counts by the lexicon of the other half,
    so they see a lexicon as unseen texts do; the lexicon that is kept comes from all.
    """
    rows = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(sample_rows)
    )
    # the broadcast side has sample_rows rows at most
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(rows), "_key")
    got = stage(sample.dropDuplicates(["_key"]), "toxicity-sample").toPandas()
    got = got.sort_values("_key")
    y = got["_label"].to_numpy() == 1
    if not y.any() or y.all():
        share = float(y.mean()) if len(y) else 0.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(None, np.array([math.log(share / (1 - share))] + [0.0] * 12))
    texts = got["_text"].fillna("").tolist()
    del got
    part = np.arange(len(texts)) % 2 == 0
    pick = lambda keep: [t for t, k in zip(texts, keep, strict=True) if k]
    counts = np.zeros((len(texts), len(NAMES)))
    for half in (part, ~part):
        other = build_automaton(learn_lexicon(pick(half), y[half], limit=terms))
        counts[~half] = Reader(other).read(pick(~half))
    weights = fit_logistic(_design(counts), y.astype(float))
    lexicon = learn_lexicon(texts, y, limit=terms)
    return Model(build_automaton(lexicon), weights, lexicon)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with toxic_hits (long), toxic_score (double) and toxic (int, score >= 0.5)."""
    kept = [f for f in docs.schema.fields if f.name not in ("toxic_hits", "toxic_score", "toxic")]
    schema = T.StructType([*kept, T.StructField("toxic_hits", T.LongType()), T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic", T.IntegerType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.automaton) if model.automaton else None
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 2000):
                c = b.slice(at, 2000)
                texts = ["" if t is None else t for t in c.column(names.index(text)).to_pylist()]
                counts = reader.read(texts) if reader else np.zeros((len(texts), len(NAMES)))
                p = model.score(counts)
                columns = [*c.columns, pa.array(counts[:, :4].sum(1).astype(np.int64)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
