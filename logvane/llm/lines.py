"""Fuzzy line deduplication: MinHash bands, exact Jaccard similarity, distributed union-find.

A line's shingles are the five characters from each of its positions, so each
character is in some; a shorter line is one shingle. Their hashes lie on a
circle with 14 fixed points on it, and each band is the five hashes that follow
one point: two lines at similarity 0.8 share none with a chance of about
(1 - 0.8^5)^14 = 0.004, and lines that share only the commonest shingles hardly
ever share one. The k = 12 least hashes are a bottom-k sketch: pairs that share
less than six of them are left out (at similarity 0.8 a chance of about 0.004).
The others are compared by their whole shingle sets. Equal lines are one line
from the start.

In a band each line first meets the least one only. Other lines of a band that
are then still in different components are held against each other by exact
bounds (sizes, bitmaps and lists of shingle classes, whose differing classes are
shingles that only one has) inside a join that hardly any unlike pair leaves. So
a line that stands in a third of all documents costs one row for each, and near
copies of one line are compared with it, not with each other.

Bands are dealt out once, as pairs of numbers; what a comparison needs is brought
only into bands that still have lines to compare.

Everything is DataFrame functions. Each different line leaves one narrow row,
written once; line texts are read again only for lines of a pair to compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text
from logvane.llm.components import connected
from logvane.session import materialize

SHINGLE = 5
SKETCH = 12
BANDS = 14
IN_BAND = 5
SHARED = 6
PERCENT = 80
# Words of a line's bitmap of shingle classes and groups that they are built in, powers of two.
WORDS = 32
GROUPS = 8
# Up to so many narrow rows (a few MB) may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 500_000

# Every character and those behind it, which are looked at, not consumed; a shorter line is one shingle.
_AT_EACH = r"(?s)(?=(.{%d}|^.{1,%d}\z))." % (SHINGLE, SHINGLE - 1)


def shingles(line: Column) -> Column:
    """Distinct hashes of a line's shingles."""
    found = F.regexp_extract_all(line, F.lit(_AT_EACH), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))


_STEP = 2**64 // BANDS
_POINTS = [-(2**63) + _STEP // 2 + _STEP * i for i in range(BANDS)]


def _high(value: Column) -> Column:
    return F.shiftright(value, 32).cast("int")


def _circle(ordered: Column) -> Column:
    """Hashes and fixed points in order."""
    return F.sort_array(F.concat(ordered, F.array(*[F.lit(p) for p in _POINTS])))


def _ranks(circle: Column) -> Column:
    """How many hashes stand before each fixed point on the circle."""
    return F.array(*[F.array_position(circle, F.lit(p)).cast("int") - 1 - i for i, p in enumerate(_POINTS)])


def _bands(ordered: Column, ranks: Column) -> Column:
    """For each fixed point a hash of the ``IN_BAND`` values behind it; behind the last value comes the first."""
    room = F.least(F.lit(IN_BAND), F.size(ordered))

    # A lambda keeps the generated code small enough to be compiled.
    def band(rank: Column, i: Column) -> Column:
        over = rank + room - F.size(ordered)
        run = F.slice(ordered, rank + 1, room)
        around = F.sort_array(F.concat(run, F.slice(ordered, F.lit(1), over)))
        return _high(F.xxhash64(i, F.when(over <= 0, run).otherwise(around)))

    return F.transform(ranks, band)


def _small(side: DataFrame) -> DataFrame:
    """A written narrow side, broadcast if counting shows that it is small."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def _lines_of(rows: DataFrame) -> DataFrame:
    """row, place, line and its hash, of lines with a word."""
    exploded = rows.select("row", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return exploded.where(F.col("line").rlike(r"\S")).withColumn("key", F.xxhash64("line"))


def _similar(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of line hashes whose shingle sets are similar enough."""
    ends = materialize(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    # A line is shorter than its set, so lines are shuffled and sets built where they meet.
    found = _texts(rows, ends).repartition("key")
    both = (
        pairs.join(found.select(F.col("key").alias("a"), F.col("line").alias("left")), "a")
        .join(found.select(F.col("key").alias("b"), F.col("line").alias("right")), "b")
        .select("a", "b", shingles(F.col("left")).alias("left"), shingles(F.col("right")).alias("right"))
        .withColumn("both", F.size(F.array_intersect("left", "right")))
    )
    either = F.size("left") + F.size("right") - F.col("both")
    return both.where(100 * F.col("both") >= percent * either).select("a", "b")


def _texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key and line, once for each of the written keys."""
    return _lines_of(rows).select("key", "line").join(_small(keys), "key").dropDuplicates(["key"])


def _sizes_fit(percent: int) -> Column:
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    return 100 * small >= percent * large


def _alike(percent: int) -> Column:
    """Whether sizes and sketches leave room for a similarity of ``percent``."""
    shared = F.size(F.array_intersect("least", "other_least"))
    return _sizes_fit(percent) & (shared >= F.least(F.lit(SHARED), F.col("n"), F.col("other_n")))


def _others(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("key").alias("other"), F.col("n").alias("other_n"), F.col("least").alias("other_least")
    )


def _fitting(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs (key, other) that may be similar, as (a, b), a below b."""
    sketches = lines.select("key", "n", "least")
    return materialize(
        pairs.distinct()
        .join(sketches, "key")
        .join(_others(lines), "other")
        .where(_alike(percent))
        .select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
    )


def _links(lines: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Verified links between the hashes of different lines."""
    met = materialize(_meeting(lines))
    stars = _fitting(
        met.where("key <> low").select("key", F.col("low").alias("other")), lines, percent
    )
    first = materialize(_similar(stars, rows, percent))
    parts = connected(first)
    # All pairs with the least line have been looked at; the others of a band need a look
    # only if they are of different components.
    part = met.where("key <> low").join(parts.withColumnRenamed("node", "key"), "key", "left")
    part = part.select("band", "key", F.coalesce("component", "key").alias("part"))
    several = part.groupBy("band").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y")
    apart = materialize(part.join(several.select("band"), "band", "left_semi"))
    # Lines are held against each other inside the join, so that pairs of unlike lines don't
    # leave it, however many lines a band has. Long lists come only to lines that bitmaps,
    # which are short, leave a partner.
    fits = (F.col("part") != F.col("other_part")) & _sizes_fit(percent)
    left, right = _two_sides(apart, _bitmaps(rows, apart))
    in_reach = left.join(right, (F.col("band") == F.col("other_band")) & fits & _bits_allow(percent), "left_semi")
    apart = materialize(in_reach.select("band", "key", "part"))
    left, right = _two_sides(apart, _class_lists(rows, apart))
    one_way = F.col("part") < F.col("other_part")
    pairs = left.join(right, (F.col("band") == F.col("other_band")) & one_way & fits & _lists_allow(percent))
    rest = pairs.select(
        F.least("key", "other_key").alias("a"), F.greatest("key", "other_key").alias("b")
    ).distinct()
    rest = materialize(rest.join(stars, ["a", "b"], "left_anti"))
    return first.union(_similar(rest, rows, percent))


def _meeting(lines: DataFrame) -> DataFrame:
    """band, key and low (the band's least key) of the lines that share a band with another line."""
    bands = lines.select("key", F.posexplode("bands").alias("i", "band"))
    # The point's number and the hash in one long: only bands of one point can meet.
    named = bands.select("key", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("band")).alias("band"))
    same = Window.partitionBy("band")
    ends = named.withColumn("low", F.min("key").over(same)).withColumn("high", F.max("key").over(same))
    return ends.where("low <> high").select("band", "key", "low")


def _two_sides(apart: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``apart`` with what ``maps`` holds of their keys, twice, the other's columns named so.

    Both are alike but for the names, so that they are shuffled once.
    """
    mine = apart.join(materialize(maps), "key")
    return mine, mine.select(*[F.col(c).alias(f"other_{c}") for c in mine.columns])


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, the number of its shingles and their hashes, of the lines of ``wanted``."""
    own = _texts(rows, materialize(wanted.select("key").distinct()))
    return own.select("key", shingles(F.col("line")).alias("set")).select("key", F.size("set").alias("n"), "set")


def _bitmaps(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n and ``bits``: which of 64 * WORDS classes its shingles fall into."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    of = lambda hashes, shift, n, i: F.filter(
        hashes, lambda h: F.shiftright(h, shift).bitwiseAND(F.lit(n - 1)) == i
    )
    # In two steps, groups of words and words, so that a shingle is looked at a few times only.
    groups = F.transform(each(GROUPS), lambda g: of("set", 6, GROUPS, g))
    word = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(bit(h)))
    bits = F.flatten(
        F.transform(groups, lambda part: F.transform(each(WORDS // GROUPS), lambda w: word(of(part, 9, WORDS // GROUPS, w))))
    )
    return _sets_of(rows, wanted).select("key", "n", bits.alias("bits"))


def _class_lists(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n and ``classes``: a list of those of 65,536 classes that its shingles fall into."""
    number = lambda h: F.shiftright(h, 32).bitwiseAND(F.lit(0xFFFF)) - 0x8000
    classes = F.array_distinct(F.transform("set", lambda h: number(h).cast("short")))
    return _sets_of(rows, wanted).select("key", "n", classes.alias("classes"))


def _room(differ: Column, percent: int) -> Column:
    """Whether the similarity is allowed where two lines differ in so many classes.

    A class that only one line has is a shingle that only one has. Of sizes n and m with d
    shingles in one line only, the similarity is (n + m - d) / (n + m + d).
    """
    return (F.col("n") + F.col("other_n")) * (100 - percent) >= differ * (100 + percent)


def _bits_allow(percent: int) -> Column:
    apart = F.zip_with("bits", "other_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return _room(F.aggregate(apart, F.lit(0), lambda total, x: total + x), percent)


def _lists_allow(percent: int) -> Column:
    both = F.size(F.array_intersect("classes", "other_classes"))
    return _room(F.size("classes") + F.size("other_classes") - 2 * both, percent)


def _row(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Names a document and orders it: null ids last, equal rows alike."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.struct(key.isNull().alias("last"), key.alias("id"), F.xxhash64(text).alias("exact"))


def _removed(rows: DataFrame, percent: int) -> DataFrame:
    """row and the places of its lines that go, for documents that lose any."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    occurrences = _lines_of(rows)
    at = F.struct("row", "place")
    ordered = (
        occurrences.select("row", "place", "key", F.sort_array(shingles(F.col("line"))).alias("all"))
        .withColumn("circle", _circle(F.col("all")))
        .withColumn("ranks", _ranks(F.col("circle")))
    )
    sketched = ordered.select(
        "row",
        "place",
        "key",
        F.size("all").alias("n"),
        F.transform(F.slice("all", 1, SKETCH), _high).alias("least"),
        _bands(F.col("all"), F.col("ranks")).alias("bands"),
    )
    firsts = materialize(
        sketched.groupBy("key").agg(
            F.min(at).alias("at"), F.count("*").alias("times"), F.first("n").alias("n"),
            F.first("least").alias("least"), F.first("bands").alias("bands"),
        )
    )
    parts = connected(_links(firsts.select("key", "n", "least", "bands"), rows, percent))
    # Lines that stand once and are linked to nothing need no further look.
    touched = firsts.join(parts.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "at", "times", F.coalesce("component", "key").alias("part"), "component"
    ).where("times > 1 or component is not null")
    heads = touched.groupBy("part").agg(F.min("at").alias("head"))
    fate = materialize(touched.join(heads, "part").select("key", "head"))
    removed = (
        occurrences.select("row", "place", "key")
        .join(_small(fate), "key")
        .where(at != F.col("head"))
        .groupBy("row")
        .agg(F.collect_set("place").alias("removed"))
    )
    return materialize(removed)

def _left(text: Column, removed: Column) -> Column:
    """A text (split in ``_lines``) without the removed places; linear in its lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), removed)
    return F.when(removed.isNull(), text).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n")
    )


def dedup_lines(
    docs: DataFrame,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_lines, n_removed and the text left, for every row.

    Of each component of lines whose similarity is ``percent`` / 100 or more
    the first stays: the one in the smallest id (null ids last), then the
    first in the text. Lines are what stands between newlines; those without
    a word are never removed. Rows equal in id and text are one document and
    get equal results. Null texts count as empty and stay null; an empty table
    gives an empty result; extra columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumn("row", _row(rows, "doc_id", "text"))
    removed = _removed(rows.select("row", "text"), percent)
    joined = rows.join(_small(removed), "row", "left")
    lost = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
    return joined.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n")).select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        lost.cast("long").alias("n_removed"),
        _left(F.col("text"), F.col("removed")).alias("text"),
    )


def without_repeats(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with all their columns, their texts as ``dedup_lines`` leaves them."""
    rows = docs.withColumn("_row", _row(docs, id_col, text_col))
    text = F.col(f"`{text_col}`")
    removed = _removed(rows.select(F.col("_row").alias("row"), text.alias("text")), percent)
    joined = rows.join(_small(removed.withColumnRenamed("row", "_row")), "_row", "left")
    joined = joined.withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    left = joined.withColumn(text_col, _left(text, F.col("removed")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
