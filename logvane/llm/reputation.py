"""Host reputation by empirical Bayes, with explicit rules before it.

Labelled page outcomes are counted for each host. Beta-binomial priors shrink
them along the name: a suffix's rate is drawn towards that of all pages, a
registered domain's towards its suffix's, a host's towards its domain's. At
each level the prior's weight comes from how much the level's members differ,
by moments. A page is judged by an upper bound of its host's posterior rate of
bad outcomes, so a host is blocked only if even a favourable reading is bad.

Everything is column expressions. Hosts with any number of pages combine on
the map side; the host table is joined without a hint, so a host that holds a
third of all pages is split by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.session import materialize

BLOCK, ALLOW = "block", "allow"
# One-sided normal quantile of the posterior bound, and the rate from which a host is blocked.
QUANTILE = 1.645
BAD_RATE = 0.5
# Bounds of a prior's weight, in pages.
WEIGHTS = (2.0, 1000.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = at > 0
    return F.when(known, lower).otherwise(""), F.when(known, path).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, ``host/path``) rule that fits, and its verdict; null if none does.

    A rule fits its host and every subdomain if the path starts with the
    rule's path. Of rules of one length, the first in order of text wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels but one) and suffix of a host.

    Without a public list of suffixes the suffix is the last two labels if
    there are three or more, else the last; the domain has one label more.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.when(n >= 3, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(
        F.element_at(labels, -1)
    )
    domain = F.when(n >= 3, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(host)
    return domain, suffix


def _prior_weight(level: DataFrame, rate: str) -> float:
    """How many pages a parent's rate counts for among its members, by moments.

    The excess of the members' squared deviations over binomial noise is the
    spread of their true rates; a large spread gives a small weight. One row
    comes to the driver.
    """
    mean, pages = F.col(rate), F.col("pages")
    noise = mean * (1 - mean)
    row = level.agg(
        F.sum(pages * F.pow(F.col("bad") / pages - mean, 2)).alias("deviation"),
        F.sum(noise).alias("expected"),
        F.sum(pages).alias("pages"),
        F.avg(noise).alias("noise"),
    ).first()
    if not row["pages"]:
        return WEIGHTS[1]
    spread = max((row["deviation"] - row["expected"]) / row["pages"], 1e-6)
    return min(max(row["noise"] / spread - 1, WEIGHTS[0]), WEIGHTS[1])


def host_reputation(outcomes: DataFrame, host_col: str = "host", bad_col: str = "bad") -> DataFrame:
    """Posterior of each host's rate of bad pages: host, pages, bad, rate, upper, lower.

    ``outcomes`` has one row for each labelled page; rows with a null host or
    outcome count for nothing. Hosts, domains and suffixes are grouped tables,
    never collected.
    """
    host = F.col(f"`{host_col}`")
    counted = (
        outcomes.select(host.alias("host"), F.col(f"`{bad_col}`").cast("int").alias("bad"))
        .where("host is not null and bad is not null")
        .groupBy("host")
        .agg(F.count("*").alias("pages"), F.sum("bad").alias("bad"))
    )
    domain, suffix = _levels(F.col("host"))
    hosts = materialize(
        counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "bad")
    )
    domains = hosts.groupBy("domain", "suffix").agg(
        F.sum("pages").alias("pages"), F.sum("bad").alias("bad")
    )
    suffixes = domains.groupBy("suffix").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))
    every = suffixes.agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages")).first()
    overall = ((every["bad"] or 0) + 0.5) / ((every["pages"] or 0) + 1)

    def shrink(level: DataFrame, rate: str, out: str) -> DataFrame:
        weight = _prior_weight(level, rate)
        shrunk = (F.col("bad") + weight * F.col(rate)) / (F.col("pages") + weight)
        return level.withColumn(out, shrunk).withColumn("weight", F.lit(weight))

    top = shrink(suffixes.withColumn("all", F.lit(overall)), "all", "suffix_rate")
    middle = domains.join(top.select("suffix", "suffix_rate"), "suffix")
    middle = shrink(middle, "suffix_rate", "domain_rate")
    last = hosts.join(middle.select("domain", "domain_rate"), "domain")
    last = shrink(last, "domain_rate", "rate")
    total = F.col("pages") + F.col("weight")
    width = QUANTILE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))
    return last.select(
        "host",
        "pages",
        "bad",
        "rate",
        F.greatest(F.lit(0.0), F.col("rate") - width).alias("lower"),
        F.least(F.lit(1.0), F.col("rate") + width).alias("upper"),
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    bad_rate: float = BAD_RATE,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's posterior for every page.

    ``outcomes`` has (page id, bad 0/1) rows. A rule's verdict stands; without
    one a page is blocked if the lower bound of its host's rate of bad pages
    reaches ``bad_rate``. Hosts without outcomes, null urls and urls without a
    host are allowed. Repeated pages are judged each by itself, repeated
    outcomes count again, and extra columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    located = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    located = located.select("page_id", host.alias("host"), path.alias("path"))
    marks = outcomes.toDF("page_id", "bad")
    reputation = host_reputation(located.where("host != ''").join(marks, "page_id"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") >= bad_rate, BLOCK).otherwise(ALLOW)
    return located.join(reputation.select("host", "rate", "lower"), "host", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(says, own).alias("verdict"),
        "rate",
        "lower",
    )
