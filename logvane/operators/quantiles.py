"""Exact order statistics in bounded memory, bracketed by mergeable sketches.

Spark's exact ``percentile`` keeps every distinct value in one aggregation
buffer. Here one wide pass of quantile sketches (``percentile_approx``, all
columns side by side) gives two values around each wanted rank. A second wide
pass counts all rows below and at these values, which proves the bracket, and
collects the few rows strictly between them, whose number the sketches bound. A
value carried by a third of all rows is an end of its bracket and is never
collected. If a bracket would still hold too many rows, it is sketched again.

Of a large table the sketches see a sample, which only decides how wide the
brackets are: every row is counted against them, a rank that they miss is looked
for again, and the values are exact. The rows inside the brackets are then
written once, and whatever follows reads this small copy.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.session import materialize

# A sketch's rank error is at most one part in this many.
ACCURACY = 10_000
# How far, as a share of the rows, a bracket reaches beyond the wanted rank.
REACH = 2 / ACCURACY
# Rows that one column's bracket may hold when it is collected.
RANKED_ROWS = 20_000
# Values of a column that are sketched: of more rows a sample of about this size, with a wider reach.
SKETCHED_ROWS = 2_000_000
SAMPLE_SEED = 42
# A first look at rows that a caller's own pass can include: ends around one probability for each column.
Brackets = dict[str, tuple[float, float]]


@dataclass(frozen=True)
class _Open:
    """The rows strictly between two values (or all), and which neighbouring ranks of them are wanted."""

    column: str
    first: int
    last: int
    rows: int
    low: float | None = None
    high: float | None = None
    reach: float = REACH
    # Whether a bracket has missed the ranks; a sample's ends need not be the table's.
    missed: bool = False

    def inside(self) -> Column:
        """The value, or null outside the range."""
        value = F.col(f"`{self.column}`")
        if self.low is not None:
            value = F.when(value > F.lit(self.low), value)
        if self.high is not None:
            value = F.when(F.col(f"`{self.column}`") < F.lit(self.high), value)
        return value

    def holds(self) -> Column:
        """Whether the value lies inside a range with two ends."""
        value = F.col(f"`{self.column}`")
        return (value > F.lit(self.low)) & (value < F.lit(self.high))

    def ends(self, share: float = 1.0) -> tuple[float, float]:
        reach = self.reach
        if share < 1.0:
            # Four standard deviations of a rank in the sample.
            reach += 2 / math.sqrt(share * self.rows)
        beyond = reach * self.rows + 1
        return max(0.0, (self.first - beyond) / self.rows), min(1.0, (self.last + 1 + beyond) / self.rows)

    def most_between(self, known: bool) -> float:
        """How many rows the bracket can have strictly inside: its share, and the sketch's error at both ends."""
        low, high = self.ends()
        share = 4 * REACH if known else high - low
        return (share + 2 / ACCURACY) * self.rows + 2


def _neighbours(ranks: Sequence[int]) -> list[list[int]]:
    """Ranks in runs without a gap: one bracket serves a run."""
    runs: list[list[int]] = []
    for rank in sorted(set(ranks)):
        if runs and rank == runs[-1][-1] + 1:
            runs[-1].append(rank)
        else:
            runs.append([rank])
    return runs


def _sketch(value: Column, low: float, high: float) -> Column:
    return F.percentile_approx(value, [low, high], ACCURACY)


def bracket(column: str, probability: float) -> Column:
    """An aggregate that a caller's pass over ``column`` can include; its array goes to ``exact_quantiles``."""
    reach = 2 * REACH
    return _sketch(F.col(f"`{column}`"), max(0.0, probability - reach), min(1.0, probability + reach))


def row_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """Values that are not null, in one pass."""
    columns = list(columns)
    row = df.agg(*[F.count(f"`{c}`") for c in columns]).first()
    return dict(zip(columns, row))


def _sample_share(spans: Sequence[_Open], sketched_rows: int) -> float:
    """The share of the rows that leaves every range at least ``sketched_rows`` values, if it has them.

    Once a bracket has missed its ranks, all rows are sketched.
    """
    return 1.0 if any(s.missed for s in spans) else min(1.0, sketched_rows / min(s.rows for s in spans))


def _sketched(df: DataFrame, spans: Sequence[_Open], share: float) -> list[tuple[float, float]]:
    seen = df.sample(share, SAMPLE_SEED) if share < 1.0 else df
    row = seen.agg(*[_sketch(s.inside(), *s.ends(share)).alias(f"s{i}") for i, s in enumerate(spans)]).first()
    return [tuple(row[i]) for i in range(len(spans))]


def _collected(df: DataFrame, spans: Sequence[_Open]) -> list[list[float]]:
    """The values of each range in order; the caller has bounded how many."""
    lists = [F.sort_array(F.collect_list(s.inside())).alias(f"l{i}") for i, s in enumerate(spans)]
    return [list(x) for x in df.agg(*lists).first()]


def _proved(
    df: DataFrame, spans: Sequence[_Open], ends: Sequence[tuple[float, float]], collect: Sequence[bool]
) -> list[tuple]:
    """Rows below and at both ends, and the values strictly between where they are to be collected."""
    wanted = []
    for i, (span, (low, high), listed) in enumerate(zip(spans, ends, collect)):
        value = span.inside()
        wanted += [
            F.count_if(value < F.lit(low)).alias(f"a{i}"),
            F.count_if(value <= F.lit(low)).alias(f"b{i}"),
            F.count_if(value < F.lit(high)).alias(f"c{i}"),
            F.count_if(value <= F.lit(high)).alias(f"d{i}"),
        ]
        between = F.when((value > F.lit(low)) & (value < F.lit(high)), value)
        wanted.append((F.sort_array(F.collect_list(between)) if listed else F.lit(None)).alias(f"e{i}"))
    row = df.agg(*wanted).first()
    return [tuple(row[5 * i : 5 * i + 5]) for i in range(len(spans))]


def _narrowed(df: DataFrame, spans: Sequence[_Open]) -> DataFrame:
    """The rows that lie in any of the ranges, written once."""
    columns = sorted({s.column for s in spans})
    inside = reduce(Column.__or__, [s.holds() for s in spans])
    return materialize(df.select(*[F.col(f"`{c}`") for c in columns]).where(inside))


def order_statistics(
    df: DataFrame,
    ranks: dict[str, Sequence[int]],
    rows: dict[str, int] | None = None,
    ranked_rows: int = RANKED_ROWS,
    brackets: Brackets | None = None,
    sketched_rows: int = SKETCHED_ROWS,
) -> dict[tuple[str, int], float]:
    """Value at each 0-based ascending rank of each column.

    Columns must be doubles without NaN or infinities; nulls are ignored. The
    frame is read two or three times, only these columns: pass written data or
    a narrow view of it that always gives the same rows.
    ``rows`` (values of each column) and ``brackets`` save passes if known.
    """
    rows = rows or row_counts(df, ranks)
    answer: dict[tuple[str, int], float] = {}
    # Each range with the rank among all rows that its own rank 0 has.
    waiting: list[tuple[_Open, int]] = []
    for column, wanted in ranks.items():
        for rank in wanted:
            if not 0 <= rank < rows[column]:
                raise ValueError(f"rank {rank} outside the {rows[column]} values of {column!r}")
        waiting += [(_Open(column, run[0], run[-1], rows[column]), 0) for run in _neighbours(wanted)]
    known = brackets or {}
    while waiting:
        small = [x for x in waiting if x[0].rows <= ranked_rows]
        if small:
            for (span, below), values in zip(small, _collected(df, [s for s, _ in small])):
                answer.update(((span.column, below + r), values[r]) for r in range(span.first, span.last + 1))
        waiting = [x for x in waiting if x[0].rows > ranked_rows]
        if not waiting:
            break
        spans = [s for s, _ in waiting]
        blind = [s for s in spans if s.column not in known]
        share = _sample_share(blind, sketched_rows) if blind else 1.0
        found = iter(_sketched(df, blind, share) if blind else [])
        ends = [known[s.column] if s.column in known else next(found) for s in spans]
        collect = [
            (s.column in known or share == 1.0) and s.most_between(s.column in known) <= ranked_rows for s in spans
        ]
        proofs = _proved(df, spans, ends, collect)
        known, still, lost = {}, [], False
        for (span, below), (low, high), proof in zip(waiting, ends, proofs):
            below_low, upto_low, below_high, upto_high, values = proof
            between, missed = [], []
            for rank in range(span.first, span.last + 1):
                if below_low <= rank < upto_low:
                    answer[span.column, below + rank] = low
                elif below_high <= rank < upto_high:
                    answer[span.column, below + rank] = high
                elif not upto_low <= rank < below_high:
                    missed.append(rank)
                elif values is not None:
                    answer[span.column, below + rank] = values[rank - upto_low]
                else:
                    between.append(rank - upto_low)
            if between:
                inner = _Open(span.column, between[0], between[-1], below_high - upto_low, low, high)
                still.append((inner, below + upto_low))
            # Where the bracket missed a rank, look again and further around it.
            still += [(replace(span, first=r, last=r, reach=4 * span.reach, missed=True), below) for r in missed]
            lost = lost or bool(missed)
        if still and not lost and max(s.rows for s in spans) > sketched_rows:
            df = _narrowed(df, [s for s, _ in still])
        waiting = still
    return answer


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probability: float,
    rows: dict[str, int] | None = None,
    ranked_rows: int = RANKED_ROWS,
    brackets: Brackets | None = None,
) -> dict[str, float]:
    """Exact quantile of each column, interpolated linearly between neighbours."""
    rows = rows or row_counts(df, columns)
    ranks, share = {}, {}
    for column in columns:
        if rows[column] == 0:
            raise ValueError(f"no values in column {column!r}")
        position = (rows[column] - 1) * probability
        lower = math.floor(position)
        share[column] = position - lower
        ranks[column] = sorted({lower, min(lower + 1, rows[column] - 1)})
    values = order_statistics(df, ranks, rows, ranked_rows, brackets)
    result = {}
    for column in columns:
        lower, upper = (values[column, r] for r in (ranks[column][0], ranks[column][-1]))
        fraction = share[column]
        result[column] = lower if fraction == 0 else lower * (1 - fraction) + upper * fraction
    return result
