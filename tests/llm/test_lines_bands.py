"""What lines of one band cost: pairs that leave the joins, and rows that bring something long."""

import random
from string import ascii_lowercase

from logvane.llm import lines


def family(draw, copies, changed):
    """Lines of 60 words that differ from one another in a few places."""
    word = lambda: "".join(draw.choice(ascii_lowercase) for _ in range(draw.randint(3, 8)))
    base = [word() for _ in range(60)]
    out = []
    for _ in range(copies):
        line = list(base)
        for at in draw.sample(range(60), changed):
            line[at] = word()
        out.append(" ".join(line))
    return out


def similarity(left, right):
    a, b = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (left, right))
    return len(a & b) / len(a | b)


def test_unlike_lines_of_one_band_leave_no_pairs(spark, monkeypatch):
    texts = family(random.Random(3), 60, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([(t,) for t in texts], "line string").selectExpr("xxhash64(line) AS key", "line")
    line_of = {r["key"]: r["line"] for r in names.collect()}
    given, similar = [], lines._similar

    def recorded(pairs, rows, percent):
        given.append([similarity(line_of[r["a"]], line_of[r["b"]]) for r in pairs.collect()])
        return similar(pairs, rows, percent)

    monkeypatch.setattr(lines, "_similar", recorded)
    lines.dedup_lines(docs).collect()
    every = [similarity(x, y) for i, x in enumerate(texts) for y in texts[:i]]
    assert sum(0.65 < j < 0.78 for j in every) > 1000
    assert all(j >= 0.78 for j in given[1])


def test_bands_of_different_points_never_meet(spark):
    rows = [(1, [7, 8]), (2, [8, 7]), (3, [9, 7]), (4, [-1, 7])]
    table = spark.createDataFrame(rows, "key long, bands array<int>")
    met = {(r["key"], r["low"]) for r in lines._meeting(table).collect()}
    assert met == {(2, 2), (3, 2), (4, 2)}
