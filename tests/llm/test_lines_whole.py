"""Line deduplication looks at whole lines, also at runs without white space."""

import random
from string import ascii_lowercase

from logvane.llm import lines

HEAD = "https://www.exam"
APART = [
    f"{HEAD}ple.com/a/history/of/the/harbour",
    f"{HEAD}ple.com/recipes?name=plum-cake&size=12",
    f"{HEAD}-results.org/2021/physics",
    "漢字仮名交じり文の最初の十六文字を" + "山の上に古い寺があり毎年春に祭りが開かれる",
    "漢字仮名交じり文の最初の十六文字を" + "港では朝早くから魚を売る声が聞こえてくる",
    "QmFzZTY0IHRleHQgd2l0aCBh" + "8f3Kd0qLmZx7RtYvB1nW5sPc",
    "QmFzZTY0IHRleHQgd2l0aCBh" + "Hj2GuE9oTa6XiCy4MbNwVr0k",
    "abc", "abd", "ab", "😀😁", "😀😂",
]


def left_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}


def test_lines_that_share_their_start_stay(spark):
    assert left_of(spark, APART) == dict(enumerate(APART))
    assert left_of(spark, ["\n".join(APART)]) == {0: "\n".join(APART)}


def test_equal_lines_go(spark):
    got = left_of(spark, [*APART, *APART])
    assert [got[k] for k in sorted(got)] == [*APART, *[""] * len(APART)]


def near_copies(draw):
    """Lines of 8 to 25 words, each followed by copies with another word or letter."""
    word = lambda: "".join(draw.choice(ascii_lowercase) for _ in range(draw.randint(3, 8)))
    out = []
    for _ in range(150):
        base = [word() for _ in range(draw.randint(8, 25))]
        other = list(base)
        other[draw.randrange(1, len(base) - 1)] = word()
        line = " ".join(base)
        at = draw.randrange(len(line))
        out += [line, " ".join(other), line[:at] + "#" + line[at + 1 :]]
    return out


def first_of_each(texts, percent=80):
    """Whether a line is the first of its component, by comparing all pairs."""
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for b, right in enumerate(sets):
        for a in range(b):
            both = len(sets[a] & right)
            if 100 * both >= percent * (len(sets[a]) + len(right) - both):
                old, new = sorted((root[a], root[b]), reverse=True)
                root = [new if r == old else r for r in root]
    return [r == i for i, r in enumerate(root)]


def test_near_copies_of_short_lines_go(spark):
    texts = near_copies(random.Random(4))
    want = first_of_each(texts)
    assert sum(want) < 0.6 * len(texts)
    got = left_of(spark, texts)
    # Bands find nearly all links; they never make one.
    assert all(got[k] == texts[k] for k, first in enumerate(want) if first)
    assert sum(bool(got[k]) for k, first in enumerate(want) if not first) <= 0.01 * len(texts)
