"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posterior.

Each rule votes for a text, against it, or abstains. How often a rule votes
right on good and on bad texts is estimated from the votes alone: texts with
the same votes are counted (at most 3^rules groups, whatever the table holds),
and expectation-maximisation runs over those counts. A text is kept by its
posterior probability of being good, not by passing every rule.

Everything that touches texts is column expressions, without a shuffle: long
texts and hot sources cost what their characters cost.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import SPACES, id_and_text, words_of
from logvane.session import materialize

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
FOR, AGAINST, ABSTAIN = 1, -1, 0
ROUNDS = 100
# What expectation-maximisation starts from: the share of good texts, and how often a vote is
# right on good and on bad ones. Rules are written to be precise and to see only some faults. This
# belief counts as many votes as the texts cast, or one common fault would take the bad class over.
PRIOR_GOOD = 0.85
PRIOR_RIGHT = (0.999, 0.35)
BELIEF = 1.0
KEEP_FROM = 0.5

RULES = (
    "symbols", "symbol_runs", "line_copies", "word_copies", "word_length", "capitals", "exclamations",
    "variety", "sentences",
)


def _shifted(values: str, step: int) -> Column:
    """Each hash combined with the one ``step`` places on; null beyond the end is left out."""
    return F.transform(values, lambda x, i: F.xxhash64(x, F.get(F.col(values), i + step)))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts the rules look at, for every row; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0
    )
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        words_of(text).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
        F.regexp_count(text, F.lit(SYMBOLS + "+")).alias("n_symbol_runs"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).alias("n_exclamations"),
        F.regexp_count(text, F.lit(r"[.!?]")).alias("n_ends"),
    )
    counted = (
        rows.withColumn("n_words", F.size("words"))
        .withColumn("n_distinct", F.size(F.array_distinct("words")))
        .withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
        .drop("words")
        .withColumn("h2", _shifted("h1", 1))
        .withColumn("h4", _shifted("h2", 2))
        .withColumn("h8", _shifted("h4", 4))
        .withColumn(
            "windows",
            F.slice("h8", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0))),
        )
        .drop("h1", "h2", "h4", "h8")
    )
    # Only texts with a repeated window are looked at closer: equal windows stand side by side
    # once sorted, and their places, sorted again, cover eight words each or up to the next.
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    same = lambda x, i: (x["h"] == F.get(F.col("placed"), i)["h"])
    found = F.transform(
        F.filter(
            "placed",
            lambda x, i: F.coalesce(same(x, i - 1), F.lit(False))
            | F.coalesce(same(x, i + 1), F.lit(False)),
        ),
        lambda x: x["at"],
    )
    covered = F.transform(
        "places",
        lambda at, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("places"), i + 1) - at, F.lit(WINDOW))
        ),
    )
    return (
        counted.withColumn("placed", placed)
        .drop("windows")
        .withColumn("places", F.array_sort(found))
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            "word_chars",
            F.col("n_symbols").cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.col("n_distinct").cast("long").alias("n_distinct_words"),
            F.col("n_symbol_runs").cast("long").alias("n_symbol_runs"),
            F.col("n_capitals").cast("long").alias("n_capitals"),
            F.col("n_exclamations").cast("long").alias("n_exclamations"),
            F.col("n_ends").cast("long").alias("n_ends"),
        )
    )


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, AGAINST).when(good, FOR).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """Each rule's vote over ``text_counts``; rules abstain between their two limits."""
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    symbols = share("n_symbols", "word_chars")
    runs = share("n_symbol_runs", "n_words")
    copies = share("n_dup_lines", "n_lines")
    repeats = share("n_repeat_words", "n_words")
    length = share("word_chars", "n_words")
    capitals = share("n_capitals", "word_chars")
    exclaimed = share("n_exclamations", "n_words")
    variety = share("n_distinct_words", "n_words")
    run = share("n_words", "n_ends")
    long_enough = F.col("n_words") >= 20
    return {
        "symbols": _vote(symbols, symbols < 0.02, symbols > 0.08),
        "symbol_runs": _vote(runs, runs < 0.05, runs > 0.25),
        "line_copies": F.when(F.col("n_lines") < 2, ABSTAIN).otherwise(
            _vote(copies, copies < 0.2, copies > 0.5)
        ),
        "word_copies": F.when(~long_enough, ABSTAIN).otherwise(
            _vote(repeats, repeats < 0.15, repeats > 0.3)
        ),
        "word_length": _vote(length, length.between(3, 11), ~length.between(2, 16)),
        "capitals": _vote(capitals, capitals < 0.15, capitals > 0.4),
        "exclamations": _vote(exclaimed, exclaimed < 0.03, exclaimed > 0.2),
        "variety": F.when(~long_enough, ABSTAIN).otherwise(
            _vote(variety, variety > 0.3, variety < 0.15)
        ),
        "sentences": F.when(~long_enough, ABSTAIN).otherwise(
            _vote(run, run < 60, run > 150)
        ),
    }


def estimate(
    groups: Sequence[tuple[Sequence[int], int]], rules: Sequence[str] = RULES
) -> tuple[float, dict[str, tuple[float, float]]]:
    """Share of good texts, and for each rule how often it votes right on good and on bad ones.

    ``groups`` are (votes, number of texts). Abstentions say nothing either
    way. The prior belief keeps every rate inside (0, 1) when a rule never votes.
    """
    good_share = PRIOR_GOOD
    right = {r: PRIOR_RIGHT for r in rules}
    total = sum(n for _, n in groups)
    for _ in range(ROUNDS if total else 0):
        good, bad = (1 + BELIEF * total * share for share in (good_share, 1 - good_share))
        seen = {r: [good * PRIOR_RIGHT[0], good, bad * PRIOR_RIGHT[1], bad] for r in rules}
        good_total = 0.0
        for pattern, n in groups:
            p = posterior(pattern, good_share, right, rules)
            good_total += n * p
            for rule, vote in zip(rules, pattern):
                if vote:
                    s = seen[rule]
                    s[0] += n * p * (vote == FOR)
                    s[1] += n * p
                    s[2] += n * (1 - p) * (vote == AGAINST)
                    s[3] += n * (1 - p)
        new_share = (good_total + PRIOR_GOOD) / (total + 1)
        right = {r: (s[0] / s[1], s[2] / s[3]) for r, s in seen.items()}
        if abs(new_share - good_share) < 1e-9:
            break
        good_share = new_share
    return good_share, right


def _weights(rates: tuple[float, float]) -> tuple[float, float]:
    """Log-likelihood ratios (good to bad) of a vote for and a vote against."""
    good, bad = (min(max(r, 1e-6), 1 - 1e-6) for r in rates)
    return math.log(good / (1 - bad)), math.log((1 - good) / bad)


def posterior(
    pattern: Sequence[int],
    good_share: float,
    right: dict[str, tuple[float, float]],
    rules: Sequence[str] = RULES,
) -> float:
    odds = math.log(good_share / (1 - good_share))
    for rule, vote in zip(rules, pattern):
        if vote:
            odds += _weights(right[rule])[vote != FOR]
    return 1 / (1 + math.exp(-max(min(odds, 500.0), -500.0)))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_from: float = KEEP_FROM,
) -> DataFrame:
    """Counts, votes, ``posterior`` and ``kept`` of every row.

    ``base_failed`` marks texts of under 20 words and texts of which over 30 %
    repeats itself; they are never kept. Null texts count as empty, repeated
    rows are judged each by itself, an empty table gives an empty result, and
    only id and text are read.
    """
    counts = materialize(text_counts(docs, id_col, text_col))
    voted = counts.select("*", *[v.cast("int").alias(f"vote_{r}") for r, v in votes().items()])
    groups = voted.groupBy(*[f"vote_{r}" for r in RULES]).count().collect()
    share, right = estimate(sorted((tuple(r)[:-1], r["count"]) for r in groups))
    odds = F.lit(math.log(share / (1 - share)))
    for rule in RULES:
        up, down = _weights(right[rule])
        vote = F.col(f"vote_{rule}")
        odds = odds + F.when(vote == FOR, up).when(vote == AGAINST, down).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
    )
