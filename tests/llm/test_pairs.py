"""N-gram join, substring dedup and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillgrid.llm import components, decontamination, ngram_join, substrings

from .helpers import clashing, documents, frame, prose, words


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None and sets[a] != sets[b] or rows[b][0] is None and sets[a] != sets[b]:
                continue
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("small,hot,block", [(24, 1 << 17, 2048), (2, 50, 4), (3, 0, 5)])
def test_classes(spark, small, hot, block):
    rows = documents()
    got = ngram_join.classes(clashing(frame(spark, rows)), small=small, hot=hot, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)


def test_classes_of_many_near_copies(spark):
    """Links at the edge of the threshold, in one group with many members."""
    rng = random.Random(3)
    base = prose(rng, 70).split()
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        rows.append((k, " ".join(w)))
    got = ngram_join.classes(frame(spark, rows), small=4, block=16)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)


def test_classes_of_nothing(spark):
    assert ngram_join.classes(frame(spark, [])).count() == 0
    assert sorted(map(tuple, ngram_join.classes(frame(spark, [(1, None), (2, "")])).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 300), (300, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {n: 0 if n < 99 or n == 300 else 100 for x in links for n in x}


def test_components_of_forests(spark):
    rng = random.Random(7)
    links = [(a, b) for a in range(30) for b in range(a)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    want = dict(map(tuple, components.components(df, "a", "b").collect()))
    assert {want[n] for n in range(30)} == {0}
    assert dict(map(tuple, components.components(df, "a", "b", size=16).collect())) == want
    thin = components.forest(df, "a", "b")
    assert thin.count() < len({n for x in links for n in x})
    assert dict(map(tuple, components.components(thin, "a", "b").collect())) == want


def test_what_the_join_deals(spark, monkeypatch):
    """Sets without candidates are not dealt, and no more links are named than there are sets."""
    rng = random.Random(5)
    base = prose(rng, 70).split()
    rows = [(k, " ".join(w if rng.random() < 0.985 else f"e{rng.randrange(50)}" for w in base)) for k in range(60)]
    rows += [(100 + k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for k in range(300)]
    named, dealt = [], []
    name, parts = ngram_join._named, ngram_join.set_parts
    monkeypatch.setattr(ngram_join, "_named", lambda links, names: named.append(links.count()) or name(links, names))
    monkeypatch.setattr(ngram_join, "set_parts", lambda *x: dealt.append(parts(*x)) or dealt[-1])
    got = ngram_join.classes(frame(spark, rows), small=4, block=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)
    assert max(named) < 60 and dealt[0].count() <= 100


def test_only_sets_that_may_be_linked_are_dealt_whole(spark, monkeypatch):
    """Texts with one line in common are a family and have hubs, but few tokens in common under the other orders."""
    rng = random.Random(8)
    line = "one line that very many of these texts have in common"
    base = prose(rng, 150, 10**6).split()
    rows = [(k, f"{line} {prose(rng, 150, 10**6)}") for k in range(60)]
    rows += [(100 + k, " ".join([line, *(w if x % 150 != k * 7 else f"e{k}" for x, w in enumerate(base))])) for k in range(20)]
    dealt, sides = [], ngram_join._sides
    monkeypatch.setattr(ngram_join, "_sides", lambda pairs, sets, *c: (c == ("set",) and dealt.append(pairs.count())) or sides(pairs, sets, *c))
    across = ngram_join._across
    many = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(ngram_join, "_across", lambda members, *x: many.add(len(members)) or across(members, *x))
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, sets, limit, verify=ngram_join.verify: verify(pairs, sets, limit).filter("b % 3 = 0"))
    got = ngram_join.classes(frame(spark, rows), small=4, hot=0, block=64)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)
    assert max(dealt) <= 50 and 0 < many.value <= 200


def test_meeting_loses_no_link():
    """Sets at the edge of the threshold meet by their prefixes under either order, those of one component need not."""
    rng, limit = np.random.default_rng(4), ngram_join.Threshold()
    for n in (1, 2, 9, 24, 25, 60, 300, 1000):
        for _ in range(20):
            pool = rng.choice(2**32, 2 * n, False).astype(np.uint32)
            least = -(-4 * 2 * n // 9)  # of two sets of n: 80 % of the union
            s, t = np.sort(pool[:n]), np.sort(np.concatenate([pool[:least], pool[n : 2 * n - least]]))
            assert limit.linked(least, n, n) and (n < 2 or not limit.linked(least - 1, n, n))
            for order in ngram_join.ORDERS:
                a, b = (ngram_join._unpacked(ngram_join._packed(x, order, limit)) for x in (s, t))
                assert a[0] == b[0] == n
                assert ngram_join._meeting([(1, "x", True, *a), (2, "y", False, *b)], limit) == [0, 1]
                assert ngram_join._meeting([(1, "x", True, *a), (2, "x", False, *b)], limit) == []


def near_copies(rng, n):
    """Short texts whose links are all close calls."""
    base = prose(rng, 34, 9000).split()
    return [(k, " ".join(w if x != k % 34 else f"e{k}" for x, w in enumerate(base))) for k in range(n)]


def test_doubtful_links_are_a_forest():
    """What a block finds grows with its members, close calls or not, and a refuted link keeps no other out."""
    limit = ngram_join.Threshold()
    sets = [np.sort(np.array([s for s in range(1, 31) if s != k % 30 + 1] + [1000 + k], np.uint32)) for k in range(60)]
    members = [(k, k, True, s) for k, s in enumerate(sets)] + [(k, k, False, s) for k, s in enumerate(sets)]
    for refuted in (frozenset(), frozenset((0, k) for k in range(1, 60) if k != 7)):
        a, b, sure = ngram_join._across(members, limit, 3, refuted)
        up = list(range(60))
        for x, y in zip(a, b, strict=True):
            up = [up[x] if r == up[y] else r for r in up]
        assert len(a) == 59 and not any(sure) and len(set(up)) == 1
        assert not {(min(x), max(x)) for x in zip(a, b, strict=True)} & refuted


def test_a_refuted_link_keeps_no_other_out(spark, monkeypatch):
    rows, asked = near_copies(random.Random(6), 90), []
    confirm = ngram_join.confirm

    def refuting(found, *x):
        asked.append(found.filter("not sure").count())
        out = confirm(found, *x)
        if len(asked) != 2:
            return out
        a, b = out.filter("holds").select("a", "b").orderBy("a", "b").first()
        return out.withColumn("holds", (out["a"] != a) | (out["b"] != b))

    monkeypatch.setattr(ngram_join, "verify", lambda pairs, sets, limit, verify=ngram_join.verify: verify(pairs, sets, limit).filter("false"))
    monkeypatch.setattr(ngram_join, "confirm", refuting)
    got = ngram_join.classes(frame(spark, rows), small=2, hot=0, block=64)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes(rows)
    assert len(asked) == 3 and min(asked[1:]) > 0


def test_marks(spark):
    sigs = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    df = spark.createDataFrame([(int(s),) for s in sigs], "sig long")
    for largest in (1 << 26, 1 << 8):  # too few bits: all are still there
        bits = ngram_join.marks(df, 500, largest)
        assert all(int(bits[s >> 6 & len(bits) - 1]) >> (s & 63) & 1 for s in sigs.tolist())


def test_repeats(spark):
    rows = documents()
    got = substrings.repeats(clashing(frame(spark, rows))).collect()
    text = {i: words(t) for i, t in rows if i is not None}
    shared: dict[tuple, set] = {}
    for i, w in text.items():
        for k in range(len(w) - 49):
            shared.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set().union(*(s for s in shared.values() if len(s) > 1))
    found = {r["doc_id"] for r in got} | {r["ref_doc_id"] for r in got}
    assert want <= found
    assert found <= {5, 7} | set(range(100, 112)) | set(range(200, 206)) | set(range(300, 305))
    for r in got:
        a, b = text[r["doc_id"]][r["start"] : r["end"]], text[r["ref_doc_id"]][r["ref_start"] : r["ref_end"]]
        assert r["doc_id"] > r["ref_doc_id"] and len(a) == r["end"] - r["start"] and len(b) == r["ref_end"] - r["ref_start"]
        assert r["equal_words"] >= 0.8 * len(a)
        if len(a) == len(b):
            assert sum(x == y for x, y in zip(a, b, strict=True)) <= len(a)
    assert substrings.repeats(frame(spark, [])).count() == 0


def test_fuzzy_passage(spark):
    rng = random.Random(9)
    p = prose(rng, 90, 5000).split()
    q = p[:30] + ["changed"] + p[31:55] + ["inserted", "words"] + p[55:]
    rows = [(1, prose(rng, 40, 5000) + " " + " ".join(p) + " " + prose(rng, 40, 5000)), (2, prose(rng, 25, 5000) + " " + " ".join(q)), (3, prose(rng, 100, 5000))]
    (r,) = substrings.repeats(frame(spark, rows)).collect()
    assert (r["doc_id"], r["ref_doc_id"]) == (2, 1)
    assert r["start"] <= 25 and r["end"] >= 115 and r["equal_words"] >= 88


def spans(rows, i):
    return sorted((r["start"], r["end"]) for r in rows if r["doc_id"] == i)


def test_later_passages_of_a_pair(spark):
    """A long passage does not hide a shorter one far behind it."""
    rng = random.Random(11)
    p, q = prose(rng, 500, 9000), prose(rng, 120, 9000)
    rows = [(k, " ".join([p, prose(rng, 300, 9000), q])) for k in (1, 2)]
    assert spans(substrings.repeats(frame(spark, rows)).collect(), 2) == [(0, 500), (800, 920)]


def test_passage_in_pieces_elsewhere(spark):
    """Other texts hold pieces of a passage that are too short; the two that share it all are still found."""
    rng = random.Random(12)
    p = prose(rng, 120, 9000).split()
    whole = [(i, " ".join([prose(rng, 30, 9000), *p, prose(rng, 30, 9000)])) for i in (50, 170)]
    for first in (1, 60):
        pieces = [(first + k, " ".join([prose(rng, 30, 9000), *p[8 * k : 8 * k + 38], prose(rng, 30, 9000)])) for k in range(10)]
        assert spans(substrings.repeats(frame(spark, whole + pieces)).collect(), 170) == [(30, 150)]


def test_passages_twice_and_runs_of_one_word(spark):
    rng = random.Random(13)
    p = prose(rng, 60, 9000)
    rows = [
        (1, " ".join([prose(rng, 10, 9000), p, prose(rng, 10, 9000)])),
        (2, " ".join([prose(rng, 100, 9000), p, prose(rng, 100, 9000), p])),
        (3, " ".join([prose(rng, 5, 9000), *["junk"] * 60, prose(rng, 5, 9000)])),
        (4, " ".join([*["junk"] * 50, prose(rng, 50, 9000), *["junk"] * 700, prose(rng, 5, 9000)])),
        (5, " ".join(["ab cd ef"] * 50)),
        (6, " ".join([prose(rng, 5, 9000), *["cd ef ab"] * 90, prose(rng, 5, 9000)])),
    ]
    got = substrings.repeats(frame(spark, rows)).collect()
    assert spans(got, 2) == [(100, 160), (260, 320)] and spans(got, 3) == []
    assert spans(got, 4) == [(0, 50), (100, 800)]
    (run,) = spans(got, 6)
    assert run[0] in (5, 6, 7) and run[1] == 275


def overlaps(a, b, least=40, identity=0.8):
    """Whether two word lists share a passage without insertions, by every diagonal."""
    places: dict = {}
    for y, w in enumerate(b):
        places.setdefault(w, []).append(y)
    seen: dict = {}
    for x, w in enumerate(a):
        for y in places.get(w, ()):
            seen[x - y] = seen.get(x - y, 0) + 1
    for d, n in seen.items():
        if n < identity * least:
            continue
        lo, hi = max(0, d), min(len(a), len(b) + d)
        sums = np.concatenate([[0], np.cumsum([1 - identity if a[x] == b[x - d] else -identity for x in range(lo, hi)])])
        if any(sums[e] - sums[s] > -1e-9 for s in range(len(sums)) for e in range(s + least, len(sums))):
            return True
    return False


def test_recall_of_changed_passages(spark):
    """All pairs of 200 texts by every diagonal, passages of 40 to 100 words with 5 to 20 % of their words changed."""
    rng = random.Random(14)
    bodies = [prose(rng, rng.randrange(40, 101), 3000).split() for _ in range(60)]
    rows = []
    for k in range(200):
        w = list(bodies[rng.randrange(60)])
        for x in rng.sample(range(1, len(w) - 1), round(len(w) * rng.choice((0, 0.05, 0.1)))):
            w[x] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join([prose(rng, rng.randrange(30), 3000), *w, prose(rng, rng.randrange(30), 3000)])))
    text = [words(t) for _, t in rows]
    want = {a for a in range(200) if any(overlaps(text[a], text[b]) for b in range(a))}
    got = substrings.repeats(frame(spark, rows)).collect()
    assert len(want) > 100 and len(want & {r["doc_id"] for r in got}) >= 0.98 * len(want)
    # pairs of one body and two texts: no other reference helps
    rows, kinds = [], []
    for k in range(300):
        body, share = prose(rng, 40 + k % 61, 3000).split(), (0.05, 0.1, 0.15, 0.2)[k % 4]
        changed = list(body)
        for x in rng.sample(range(1, len(body) - 1), int(len(body) * share)):
            changed[x] = f"c{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join([prose(rng, 20, 3000), *body, prose(rng, 20, 3000)])), (2 * k + 1, " ".join([prose(rng, 30, 3000), *changed, prose(rng, 10, 3000)]))]
        kinds.append(share)
    found = {r["doc_id"]: r["end"] - r["start"] for r in substrings.repeats(frame(spark, rows)).collect()}
    for share in (0.05, 0.1, 0.15, 0.2):
        mine = [2 * k + 1 for k in range(300) if kinds[k] == share]
        assert sum(i in found for i in mine) >= (0.9 if share == 0.2 else 0.98) * len(mine), share


def test_hot_passage_in_buffers(spark):
    """One passage in every text, many buffers and buckets: every text but the first is reported."""
    rng = random.Random(15)
    p = prose(rng, 60, 9000)
    rows = [(k, " ".join([prose(rng, 15, 9000), p, prose(rng, 15, 9000)])) for k in range(300)]
    got = substrings.repeats(frame(spark, rows).repartition(7), options=substrings.Options(buffer_bytes=4000, bucket_bytes=2000)).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 300))
    # a word or two beside it may be equal by chance
    assert all(10 <= r["start"] <= 15 and 75 <= r["end"] <= 80 for r in got)
    assert max(sum(r["ref_doc_id"] == k for r in got) for k in range(300)) < 200


@pytest.mark.parametrize("buffer_bytes", [4000, 32 << 20])
def test_partners_by_hot_seeds(spark, buffer_bytes):
    """Texts whose only common seeds lie in a line that many texts hold, far apart in the order of ids: beside the line runs of
    four words are equal, or of two, or single ones (80 % in all)."""
    rng = random.Random(18)
    rows, want = [], {}
    for line, run, turns in ((13, 4, 3), (16, 2, 4), (24, 1, 4)):
        hot, first = prose(rng, line, 9000), len(rows)
        left, right = ([prose(rng, run, 9000) for _ in range(turns)] for _ in range(2))
        for k in range(90):
            if k not in (40, 89):
                sides = [prose(rng, turns * (run + 1), 9000) for _ in range(2)]
            else:
                sides = [" ".join(f"{w} x{rng.randrange(10**9)}" for w in left), " ".join(f"x{rng.randrange(10**9)} {w}" for w in right)]
            rows.append((first + k, " ".join([prose(rng, 5, 9000), sides[0], hot, sides[1], prose(rng, 5, 9000)] if k else [prose(rng, 30, 9000), hot])))
        want[first + 89] = (first + 40, 2 * turns * run + line)
    got = substrings.repeats(frame(spark, rows).repartition(5), options=substrings.Options(buffer_bytes=buffer_bytes)).collect()
    assert {r["doc_id"]: (r["ref_doc_id"], r["equal_words"]) for r in got} == want


def test_disk_of_hot_seeds(spark):
    """The tokens around a place of a hot seed travel as one row (of a very hot one: a row a part), and shuffle files don't outlive their step."""
    o, rng = substrings.Options(), random.Random(20)
    texts = [(k, prose(rng, 200, 9000)) for k in range(50)]
    docs = frame(spark, texts).selectExpr("doc_id id", "text")
    for many, parts in ((50, 1), (5 << 13, 5)):
        places = spark.createDataFrame([(k, 7, x, True, many) for k, _ in texts for x in (3, 100)], "id long, seed long, place int, open boolean, many long")
        got = substrings._spread(places, docs, o, 0).collect()
        assert len(got) == 100 * parts
        tokens = {}
        for r in got:
            own = tokens.setdefault((r["id"], r["place"]), {})
            assert len(r["tokens"]) == 2 * len(r["marks"])
            own.update(zip((int(x) // 2 for x in np.frombuffer(r["marks"], np.uint16)), np.frombuffer(r["tokens"], np.uint32).tolist(), strict=True))
        assert {(p, len(t)) for (_, p), t in tokens.items()} == {(3, 3 + o.k + 74 - 2), (100, 74 + o.k + 74 - 2)}
        assert all(sorted(t) == list(range(len(t))) for t in tokens.values())

    def shuffles():
        return {f.getName().split("_")[1] for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before = shuffles()
    assert substrings.repeats(frame(spark, [(k, t) for k, (_, t) in enumerate(texts + texts)])).count() == 50
    assert len(shuffles() - before) <= 2  # the sum of the sizes, the count


def test_settled_places_leave_other_partners(spark):
    """Copies of a text are taken once, and all partners of seeds that are not hot are found."""
    rng = random.Random(19)
    p = prose(rng, 60, 9000).split()
    changed = [" ".join(w if x % 20 != k else f"c{k}" for x, w in enumerate(p)) for k in range(20)]
    rows = [(k, " ".join([prose(rng, 15, 9000), t, prose(rng, 15, 9000)])) for k, t in enumerate(changed)]
    got = {(r["doc_id"], r["ref_doc_id"]) for r in substrings.repeats(frame(spark, rows)).collect()}
    assert got == {(a, b) for a in range(20) for b in range(a)}
    rows = [(k, " ".join(p)) for k in range(80)]
    got = substrings.repeats(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 80)) and {(r["start"], r["end"]) for r in got} == {(0, 60)}


def test_chains_follow_brute_force():
    """The best chain's score is that of a quadratic program, and every fragment is in one chain."""
    rng = np.random.default_rng(5)
    o = substrings.Options()

    def link(a, b):
        """What b adds after a, or None."""
        cut = min(o.k - 1, a[2] - 1)
        dx, dy = b[0] - (a[0] + a[2] - cut), b[1] - (a[1] + a[2] - cut)
        return None if dx < 0 or dy < 0 else b[2] - o.skip_cost * (dx + dy) / 2 - o.gap_cost * abs(dx - dy)

    for turn in range(150):
        n, size = int(rng.integers(1, 50)), (60, 300, 5000)[turn % 3]
        p = np.unique(np.stack([rng.integers(0, size, n), rng.integers(0, size, n), rng.integers(5, 40, n)], 1), axis=0)
        best = [float(f[2]) for f in p]
        for i in np.lexsort((p[:, 1], p[:, 0])):
            best[i] = max([best[i], *(best[j] + s for j in range(len(p)) if (s := link(p[j], p[i])) is not None)])
        made = substrings.chains(p, o)
        assert sorted(k for c in made for k in c) == list(range(len(p)))
        got = float(p[made[0][0], 2]) + sum(link(p[a], p[b]) for a, b in zip(made[0], made[0][1:], strict=False))
        assert abs(got - max(best)) < 1e-6


def test_repeated_ids_and_nulls_of_passages(spark):
    rng = random.Random(16)
    p, q = prose(rng, 60, 9000), prose(rng, 60, 9000)
    rows = [(1, p), (2, p), (2, q), (2, p), (3, q), (None, p), (4, None), (5, "")]
    assert sorted((r["doc_id"], r["ref_doc_id"], r["start"], r["end"]) for r in substrings.repeats(frame(spark, rows)).collect()) == [(2, 1, 0, 60), (3, 2, 0, 60)]


def test_overlaps(spark):
    rng = random.Random(4)
    items = [(1, prose(rng, 40, 9000)), (2, "short item of five words"), (3, None), (4, ""), (5, "two words"), (6, prose(rng, 40, 9000))]
    w = items[0][1].split()
    changed = list(w)
    changed[11] = changed[24] = "other"
    rows = [
        (1, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 5)),
        (2, prose(rng, 30) + " " + " ".join(changed).upper().replace("X", "x")),
        (3, prose(rng, 200)),
        (4, "a short item of five words b"),
        (5, "two words"),
        (6, None),
        (7, ""),
        (None, " ".join(w)),
        (9, " ".join(w[:10]) + " " + prose(rng, 20)),
        (10, " ".join(w[5:25])),
        (1, prose(rng, 3)),
    ]
    docs = clashing(frame(spark, rows))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 30):
        got = decontamination.find_overlaps(docs, bench, block_words=block).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted([(1, 1), (2, 1), (4, 2), (None, 1), (10, 1)], key=str)
        by = {(r["doc_id"], r["item_id"]): r for r in got}
        assert (by[1, 1]["start"], by[1, 1]["end"], by[1, 1]["matched"]) == (30, 70, 40)
        assert by[2, 1]["matched"] == 38 and by[4, 2]["start"] == 1
        kept = decontamination.drop_overlapping(docs, bench, block_words=block)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 9]
    assert decontamination.find_overlaps(frame(spark, []), bench).count() == 0
    assert decontamination.find_overlaps(docs, bench.limit(0)).count() == 0


def test_overlaps_with_many_substitutions(spark):
    """Longer tolerant overlaps beside short exact runs, and every length of item."""
    rng = random.Random(8)
    w = [prose(rng, n, 9000).split() for n in (16, 20, 13, 40)]
    items = [(k, " ".join(x)) for k, x in enumerate(w)]
    rows = []
    for k, places in enumerate(((12,), (5, 10, 15), (0,), (13, 14, 15, 16, 17, 22))):
        x = list(w[k])
        for p in places:
            x[p] = "other"
        rows.append((k, prose(rng, 10) + " " + " ".join(x) + " " + prose(rng, 10)))
    got = decontamination.find_overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["item_start"], r["item_end"], r["matched"]) for r in got) == [(0, 0, 0, 16, 15), (1, 1, 0, 20, 17), (2, 2, 0, 13, 12), (3, 3, 0, 40, 34)]


def test_longest_stretch_follows_brute_force():
    rng = random.Random(2)
    for _ in range(500):
        e = np.array([rng.random() < 0.75 for _ in range(rng.randrange(30))], bool)
        sizes = [j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if e[i] and e[j - 1] and e[i:j].sum() >= 4 * (~e[i:j]).sum()]
        lo, hi, matched = decontamination._stretch(e, 4)
        assert hi - lo == max(sizes, default=0) and matched == e[lo:hi].sum()


def test_every_overlap_of_an_item(spark):
    """An item held twice, and two separate fragments of one."""
    rng = random.Random(6)
    w, v = prose(rng, 40, 9000), prose(rng, 60, 9000)
    f = v.split()
    rows = [(1, " ".join([w, prose(rng, 10), w])), (2, " ".join([*f[:15], prose(rng, 30), *f[40:]])), (3, " ".join([*f[:20], *["other"] * 20, *f[40:]]))]
    got = decontamination.find_overlaps(frame(spark, rows), spark.createDataFrame([(1, w), (2, v)], "item_id long, text string")).collect()
    spans = sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["item_start"], r["item_end"], r["matched"]) for r in got)
    assert spans == [(1, 1, 0, 40, 0, 40, 40), (1, 1, 50, 90, 0, 40, 40), (2, 2, 0, 15, 0, 15, 15), (2, 2, 45, 65, 40, 60, 20), (3, 2, 0, 20, 0, 20, 20), (3, 2, 40, 60, 40, 60, 20)]


def test_one_row_of_each_class(spark):
    rows = documents() + [(7, "another text of the same id as an earlier row"), (8, "")]
    docs = clashing(frame(spark, rows))
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    of = {}
    for (i, _, c), (_, t) in zip(sorted(((i, n, c) for i, n, c in brute_classes(rows)), key=str), sorted(rows, key=str), strict=False):
        of[i] = c
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    sets = {}
    for k, (i, t) in enumerate(rows):
        sets.setdefault(shingles(t), []).append(i)
    # each class has one row; every set is linked with a kept one or was kept
    assert all(i is None or not t or not words(t) or of[i] == i or i in (7, 8) for i, t in kept)
    assert sorted(map(str, (i for i, _ in kept if i is None))) == ["None", "None"]
    assert len([1 for i, t in kept if i == 7]) == 2 and len([1 for i, t in kept if i == 8]) == 2
    named = [(i, shingles(t)) for i, t in kept if i is not None]
    assert len(named) == len(set(named))
    for i, t in rows:
        if i is not None and shingles(t):
            assert any(s and 100 * len(s & shingles(t)) >= 80 * len(s | shingles(t)) for _, s in named) or of[i] != i
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_short_items_follow_brute_force(spark):
    """Items of 3 to 11 words, some words substituted, each held twice: every place where four fifths agree."""
    rng = random.Random(17)
    items = [(k, " ".join(f"v{rng.randrange(5)}" if k % 2 else f"u{rng.randrange(10**6)}" for _ in range(3 + k % 9))) for k in range(36)]
    rows = []
    for k, x in items:
        parts = []
        for lost in (0, 1, 2):
            w = x.split()
            for p in rng.sample(range(len(w)), lost):
                w[p] = "other"
            parts += [prose(rng, 6), " ".join(w)]
        rows.append((k, " ".join(parts)))
    want = set()
    for i, t in rows:
        w = words(t)
        for k, x in items:
            own = words(x)
            for at in range(len(w) - len(own) + 1):
                same = sum(a == b for a, b in zip(w[at : at + len(own)], own, strict=True))
                if same >= 4 * (len(own) - same):
                    want |= {(i, k, p) for p in range(at, at + len(own))}
    got = decontamination.find_overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], p) for r in got for p in range(r["start"], r["end"])} == want
    nine = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "a b c d e f")], "item_id long, text string")
    (r,) = decontamination.find_overlaps(frame(spark, [(1, "so one two three four other six seven eight nine it is"), (2, "a b x d e")]), nine).collect()
    assert (r["doc_id"], r["item_id"], r["start"], r["end"], r["matched"]) == (1, 1, 1, 10, 8)


def test_seed_that_all_items_share(spark, monkeypatch):
    """Items with one beginning, equal items (ties) and a text that holds it many times."""
    rng = random.Random(18)
    head = prose(rng, 20, 9000)
    items = [(k, f"{head} {prose(rng, 10, 9000)}") for k in range(50)] + [(100, f"{head} end"), (101, f"{head} end")]
    rows = [(1, " ".join(f"{head} {prose(rng, 3, 9000)}" for _ in range(20))), (2, prose(rng, 50))]
    monkeypatch.setattr(decontamination, "EXPANDED", 64)
    got = decontamination.find_overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["item_id"], r["start"]) for r in got} == {(k, 23 * n) for k, _ in items for n in range(20)}
    assert {r["matched"] for r in got} == {20}
