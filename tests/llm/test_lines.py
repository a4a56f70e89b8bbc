"""Line deduplication against all pairs of lines."""

import random
import re
from collections import defaultdict


from logvane.llm import lines, queries


def shingles(line):
    """Five characters from every position; a shorter line is one shingle."""
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def by_hand(rows, percent=80):
    """Text left of each (doc_id, text); ids are unique, null last."""
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for key, text in sorted(rows, key=order):
        for place, line in enumerate((text or "").split("\n")):
            if re.search(r"\S", line):
                first.setdefault(line, (key, place))
    sets = {line: shingles(line) for line in first}
    root = {line: line for line in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for line, s in sets.items():
        near = {other for x in s for other in holders[x]}
        for other in near:
            both = len(s & sets[other])
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = find(line), find(other)
                if a != b:
                    root[a] = b
        for x in s:
            holders[x].append(line)
    head = {}
    for line, at in first.items():
        r = find(line)
        head[r] = min((head.get(r, at), at), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return {
        key: text
        and "\n".join(
            x
            for place, x in enumerate(text.split("\n"))
            if not re.search(r"\S", x) or head[find(x)] == (key, place)
        )
        for key, text in rows
    }


def test_real_documents(spark, testdata):
    docs = queries.documents(spark, testdata)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = by_hand(rows)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert set(got) == set(want)
    # Bands find nearly all links; a missed one changes a document.
    assert sum(got[k]["text"] != want[k] for k in want) <= 0.005 * len(want) + 1
    assert sum(r["n_removed"] for r in got.values()) > 0
    query = queries.op4_lines(spark, testdata)
    assert query.count() == len(rows)


def test_planted_lines(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9)))
    bases = [[word() for _ in range(draw.randint(1, 60))] for _ in range(30)]
    rows = []
    for key in range(150):
        text = []
        for _ in range(draw.randint(0, 6)):
            line = list(draw.choice(bases))
            if draw.random() < 0.4:
                line[draw.randrange(len(line))] = word()
            text.append(" ".join(line))
            if draw.random() < 0.1:
                text.append(draw.choice(["", "  ", "ß 漢字 é", "\x0bx\r"]))
        rows.append((key, "\n".join(text)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, rows[3][1]), (503, "y " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key long, line string")
    want = by_hand(rows)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs.union(docs.limit(4))).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    assert lines.dedup_lines(docs.union(docs.limit(4))).count() == len(rows) + 4
    kept = lines.dedup_lines(docs).where("doc_id = 501 or doc_id = 502").orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"]) for r in kept] == [(1, 0), (3, 0)]


def test_native(spark, testdata):
    plan = lines.dedup_lines(queries.documents(spark, testdata))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
