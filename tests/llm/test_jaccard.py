"""The Jaccard join against all pairs compared by hand."""

import random
from collections import defaultdict

import numpy as np
import pytest

from logvane.llm import jaccard, queries
from logvane.llm.components import connected


def shingles(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = max(len(words) - size + 1, 1)
    return frozenset(tuple(words[i : i + size]) for i in range(n))


def by_hand(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = min((k for k in (least.get(r), key) if k is not None), default=None)
    return sorted(
        ((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str
    )


def test_op2_equals_all_pairs(spark, testdata):
    for size in ("sf0.001", "sf0.01"):
        folder = testdata.replace("sf0.001", size)
        rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, folder).collect()]
        got = sorted((tuple(r) for r in queries.op2_jaccard(spark, folder).collect()), key=str)
        assert got == by_hand(rows, 85)


def edited(draw, words, share):
    return [draw.choice("abcdefgh") * 3 + str(draw.randint(0, 9999)) if draw.random() < share else w for w in words]


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_planted_groups(spark, percent):
    draw = random.Random(percent)
    rows, common = [], [f"c{i}" for i in range(40)]
    for group in range(12):
        base = [f"w{draw.randint(0, 4000)}" for _ in range(draw.randint(3, 120))]
        for _ in range(draw.choice([1, 3, 25])):
            words = edited(draw, base, draw.choice([0, 0.005, 0.02, 0.06]))
            if group % 2:
                words = words[:10] + common + words[10:]
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "x"), (904, "X"), (None, "x"), (None, "alone here")]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key long, node long")
    got = jaccard.near_duplicates(docs, 4, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, percent)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(40)]
    loose = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(7, 7), (None, 3)]
    hub = [(0, i) for i in range(1, 300)]
    for edges in (chain, loose, hub, []):
        root = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        frame = spark.createDataFrame(edges, "a long, b long")
        got = {r["node"]: r["component"] for r in connected(frame).collect()}
        assert got == {x: find(x) for x in root}


def test_bitmaps_never_rule_out_a_link():
    """The classes that differ are at most the elements that differ, whatever the sets."""
    draw = np.random.default_rng(6)
    for _ in range(300):
        common = draw.integers(0, 2**63, draw.integers(0, 900)).astype(np.uint64)
        own = [np.unique(np.append(common, draw.integers(0, 2**63, draw.integers(0, 120)).astype(np.uint64))) for _ in "ab"]
        differ = len(np.setxor1d(*own))
        maps = [jaccard.bitmap(x) for x in own]
        assert sum(int(x).bit_count() for x in maps[0] ^ maps[1]) <= differ
