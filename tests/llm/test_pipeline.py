"""The corpus pipeline: each stage against a brute-force version, on rows with nulls, copies, clashes and repeated ids."""

from __future__ import annotations

import random
import re

import pytest


from .helpers import documents, frame, prose, words
from .test_pairs import shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic, copied, contaminated and personal documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    items = [(k, prose(rng, 30, 9000)) for k in range(4)]
    rows = documents()
    rows += [(1000 + k, " ".join([prose(rng, 40), *rng.sample(["idiot", "moron", "worthless", "scumbag"], 3), prose(rng, 20)])) for k in range(60)]
    rows += [(2000 + k, " ".join([prose(rng, 20), items[k % 4][1], prose(rng, 20)])) for k in range(8)]
    rows += [(3000 + k, f"{prose(rng, 20)} ann{k}@example.com and 10.0.0.{k} {prose(rng, 5)}") for k in range(20)]
    rows += [(7, "a second text of an id that another row has"), (3000, "a second text " + prose(rng, 30))]
    frame(spark, rows).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 1060)) for i, _ in rows if i is not None and (i < 60 or i >= 1000)], "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path, rows, items


def content(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, folder):
    import corpus_pipeline as P

    path, rows, items = folder
    docs = spark.read.parquet(path + "/documents.parquet").selectExpr("*", "99 as toxic", "'x' as sig", "5 as `row`")
    assert [n for n, _ in P.STAGES] == ["toxicity", "n-gram join", "decontamination", "personal data", "packing"]

    clean = P.drop_toxic(spark, docs, path)
    assert clean.columns == docs.columns and {r["toxic"] for r in clean.collect()} == {99}
    assert content(clean) == sorted(((i, t) for i, t in rows if i is None or not 1000 <= i < 1060), key=str)

    one = P.one_of_each_class(spark, clean, path)
    assert one.columns == docs.columns
    kept, given = content(one), content(clean)
    sets = [(i, t, shingles(t)) for i, t in given]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    up = list(range(len(sets)))
    for x in range(len(sets)):  # classes, by repeated passes over all pairs
        for y in range(x):
            if near(sets[x][2], sets[y][2]):
                lo, hi = sorted((up[x], up[y]))
                up = [lo if c == hi else c for c in up]
    want = {}
    for (i, t, s), c in zip(sets, up, strict=True):
        if i is not None:
            name = (i,) if not s else (c,)
            want[name] = min(want.get(name, i), i)
    assert sorted(i for i, _ in kept if i is not None) == sorted(want.values())
    assert [x for x in kept if x[0] is None] == [x for x in given if x[0] is None]

    rest = P.drop_contaminated(spark, one, path)
    bad = lambda t: any(" ".join(words(x)[k : k + 13]) in " ".join(words(t)) for _, x in items for k in range(18))
    assert rest.columns == docs.columns and content(rest) == [x for x in kept if not bad(x[1])]

    free = P.redact_personal_data(spark, rest, path)
    hidden = lambda t: t and re.sub(r"10\.0\.0\.[0-9]+", "[IP]", re.sub(r"ann[0-9]+@example\.com", "[EMAIL]", t))
    assert free.columns == docs.columns and content(free) == sorted(((i, hidden(t)) for i, t in content(rest)), key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in free.collect())

    packed = P.pack_lengths(spark, free, path).collect()
    assert sorted(((r["doc_id"], r["length"]) for r in packed), key=str) == sorted(((i, len(words(t))) for i, t in content(free)), key=str)


def test_run(spark, folder):
    import corpus_pipeline as P

    path, rows, _ = folder
    docs, steps = spark.read.parquet(path + "/documents.parquet"), []
    for _, step in P.STAGES:
        docs = step(spark, docs, path).cache()
        steps.append(docs.count())
    got = P.run(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert steps[0] > steps[1] > steps[2] == steps[3] == steps[4]
    small = spark.read.parquet(path + "/documents.parquet").limit(0).drop("n_chars")
    for _, step in P.STAGES:
        small = step(spark, small, path)
        assert small.count() == 0
