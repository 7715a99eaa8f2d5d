"""Small fixtures: documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def documents(seed=1, n=60):
    """(doc_id, text) rows: copies, near copies, a shared passage, short, empty, null and long texts."""
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.randrange(20, 160))) for k in range(n)]
    base = rows[5][1].split()
    for k in range(12):  # near copies
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, rows[7][1]) for k in range(6)]  # copies
    passage = prose(rng, 60)
    rows += [(300 + k, prose(rng, 50) + " " + passage + " " + prose(rng, 40)) for k in range(5)]
    rows += [(400, ""), (401, None), (402, "one two"), (403, "ONE\ttwo"), (404, "   "), (405, "same " * 3000), (406, prose(rng, 9000, 100_000)), (None, rows[7][1]), (None, "lonely")]
    rows += [(500, "twice the same row of words here"), (500, "twice the same row of words here")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def clashing(df):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("id", "key", "sig", "n", "token", "rank", "bin", "arc", "shard", "score", "pii", "secrets", "toxic", "toxic_score", "assign", "run", "length", "bucket", "value", "ref", "seed", "place", "hash", "row", "size", "item", "start", "end", "payload", "first", "vector", "code")
    return df.withColumns({n: F.lit(1) for n in names if n not in df.columns})
