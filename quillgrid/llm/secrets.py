"""Secret scans: character Markov models of random strings and of ordinary identifiers.

Runs of identifier characters are scored by the log-likelihood ratio of a first-order
Markov model of random strings to one of ordinary identifiers.  The labelled samples are
the corpus' own: runs that touch a match of the fixed formats below are random, all
others ordinary.  Ordinary ones are of two sorts, names and numbers (digits alone), each
with a model of its own: a number counts as whichever explains it better, as it looks
random to a model of names.  The counting of runs and character pairs is one aggregate
over all texts, the scoring a second pass, both DataFrame expressions; the driver sees
only the table of pairs (67 x 67 at most for each class).

Offsets come from ``split`` and ``regexp_extract_all`` by the same pattern: the
gaps and the matches alternate, so running sums of their lengths are positions.  The
sums are taken by chunks of ``CHUNK`` matches, so their cost grows with the matches.

Defined results: a null text counts as empty; a text without matches has empty
lists; with no random or no ordinary run in the corpus the models add nothing;
repeated rows are scanned alike; an empty table gives no rows; other columns pass
through, whatever their names, but for one named like the output column, which is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed formats (kind, pattern, least length of the group, group).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
DIGITS = "0123456789"
KINDS = ("assign", "access", "hex", "markov")
#: Classes of runs: random strings, numbers, names.
RANDOM, NUMBER, NAME = 0, 1, 2

#: Matches whose places are summed up at once.
CHUNK = 128
_SPAN = "struct<start:bigint,end:bigint,value:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """array of (start, end, value) of the pattern's leftmost non-overlapping matches; offsets in code points."""
    p = F.lit(pattern)
    none = F.array().cast(f"array<{_SPAN}>")

    def located(whole: Column) -> Column:
        # the last gap has no match beside it: no position after it is asked for
        parts = F.arrays_zip(
            F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"),
            whole.alias("hit"),
            (F.regexp_extract_all(text, p, F.lit(group)) if group else whole).alias("value"),
        )
        return _let(parts, lambda x: _let(F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(x) - 1, F.lit(CHUNK)).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK))), placed))

    def placed(chunks: Column) -> Column:
        long = lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")
        empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("made"))
        starts = F.aggregate(
            F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + long(x))),
            empty,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["made"], F.array(acc["at"])).alias("made")),
            lambda acc: acc["made"],
        )

        def spans(chunk: Column, start: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                begin = acc["at"] + F.length(x["gap"])
                end = begin + F.length(x["hit"])
                return F.struct(end.cast("long").alias("at"), F.concat(acc["made"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), x["value"].alias("value")))).alias("made"))

            return F.aggregate(chunk, F.struct(start.alias("at"), none.alias("made")), step, lambda acc: acc["made"])

        return F.flatten(F.zip_with(chunks, starts, spans))

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, p, F.lit(0)), located)).otherwise(none)


def base_spans(text: Column) -> Column:
    """struct of assign, access, hex and run: arrays of (start, end, value)."""
    body = F.coalesce(text, F.lit(""))
    return F.struct(
        F.filter(_located(body, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6).alias("assign"),
        _located(body, ACCESS).alias("access"),
        _located(body, HEX).alias("hex"),
        _located(body, RUN).alias("run"),
    )


def _touches(spans: Column, r: Column) -> Column:
    hit = lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])
    return F.exists(spans["assign"], hit) | F.exists(spans["access"], hit) | F.exists(spans["hex"], hit)


def _numeric(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def _chain(counted: list, sort: int, alphabet: str, smoothing: float, backoff: float) -> dict[str, float]:
    """Log probability of every pair's second character after its first."""
    seen = {r["pair"]: r["n"] for r in counted if r["sort"] == sort and r["pair"]}
    single = {b: sum(seen.get(a + b, 0) for a in alphabet) + smoothing for b in alphabet}
    total = sum(single.values())
    out = {}
    for a in alphabet:
        row = sum(seen.get(a + b, 0) for b in alphabet)
        out |= {a + b: math.log((seen.get(a + b, 0) + backoff * single[b] / total) / (row + backoff)) for b in alphabet}
    return out


def fit(docs: DataFrame, *, text: str = "text", smoothing: float = 0.5, backoff: float = 1000.0) -> tuple[list[float], list[float], float] | None:
    """(log ratio of every pair of characters to names, of every pair of digits to numbers, threshold): counts over all texts.

    A pair's probability leans on its second character's own, as ``backoff`` observations, so
    that an unlabelled secret among the ordinary runs does not vouch for itself.
    The threshold is the log odds of an ordinary run, plus ln 100: a run is reported
    if it is a hundred times as likely to be random.
    """
    found = docs.select(base_spans(F.col(text)).alias("s"))
    sort = lambda r: F.when(_touches(F.col("s"), r), RANDOM).when(_numeric(r["value"]), NUMBER).otherwise(NAME)
    runs = found.select(F.explode(F.transform("s.run", lambda r: F.struct(sort(r).alias("sort"), r["value"].alias("value")))).alias("r")).select("r.*")
    # the empty pair counts the runs
    pairs = F.transform(F.sequence(F.lit(0), F.length("value") - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.substr(F.col("value"), i, F.lit(2))))
    counted = runs.select("sort", F.explode(pairs).alias("pair")).groupBy("sort", "pair").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 x (67 x 67 + 1) rows at most
    totals = {r["sort"]: r["n"] for r in counted if r["pair"] == ""}
    ordinary = totals.get(NUMBER, 0) + totals.get(NAME, 0)
    if not ordinary or not totals.get(RANDOM):
        return None
    strings, names = (_chain(counted, k, ALPHABET, smoothing, backoff) for k in (RANDOM, NAME))
    numbers = _chain(counted, NUMBER, DIGITS, smoothing, backoff)
    return (
        [round(strings[a + b] - names[a + b], 6) for a in ALPHABET for b in ALPHABET],
        [round(strings[a + b] - numbers[a + b], 6) for a in DIGITS for b in DIGITS],
        math.log(ordinary / totals[RANDOM]) + math.log(100),
    )


def scan(docs: DataFrame, model: tuple[list[float], list[float], float] | None, *, text: str = "text") -> DataFrame:
    """``docs`` with secrets: an array of (kind, start, end, value, score) by start, then kind as in KINDS.

    ``score`` is the log-likelihood ratio of kind markov, else null.
    """
    def tagged(kind: str, k: int, column: Column, score) -> Column:
        return F.transform(
            column,
            lambda m: F.struct(m["start"], F.lit(k).alias("order"), F.lit(kind).alias("kind"), m["end"], m["value"], score(m).cast("double").alias("score")),
        )

    def listed(spans: Column) -> Column:
        none = lambda m: F.lit(None)
        lists = [tagged(kind, k, spans[kind], none) for k, kind in enumerate(KINDS[:3])]
        if model is not None:
            to_names, to_numbers, threshold = model

            def ratio(m: Column, alphabet: str, values: list[float]) -> Column:
                table = F.from_json(F.lit(str(values)), "array<double>")
                # split by the empty pattern ends with an empty string where the length is not limited
                codes = F.transform(F.split(m["value"], "", -1), lambda c: F.instr(F.lit(alphabet), c))
                steps = lambda c: F.zip_with(F.slice(c, 1, F.length(m["value"]) - 1), F.slice(c, 2, F.length(m["value"]) - 1), lambda a, b: F.get(table, (a - 1) * len(alphabet) + b - 1))
                return _let(codes, lambda c: F.aggregate(steps(c), F.lit(0.0), lambda s, x: s + x))

            def likelihood(m: Column) -> Column:
                name = ratio(m, ALPHABET, to_names)
                return F.when(_numeric(m["value"]), F.least(name, ratio(m, DIGITS, to_numbers))).otherwise(name)

            free = F.filter(spans["run"], lambda r: ~_touches(spans, r))
            lists.append(F.filter(tagged("markov", 3, free, likelihood), lambda m: m["score"] > threshold))
        return F.transform(F.array_sort(F.concat(*lists)), lambda m: F.struct(m["kind"], m["start"], m["end"], m["value"], m["score"]))

    return docs.withColumn("secrets", _let(base_spans(F.col(text)), listed))
