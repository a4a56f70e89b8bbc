"""Queries over the given tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.llm import (
    alignment,
    bpe,
    fingerprints,
    jaccard,
    language,
    lexical,
    lines,
    packing,
    quality,
    reputation,
    rules,
    secret_scan,
    substrings,
)
from logvane.llm.common import documents, is_held_out

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = labels(spark, sf_dir).where(~is_held_out(F.col("doc_id")))
    scored = quality.classify(documents(spark, sf_dir), known)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), size=4, percent=85)


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "posterior", "kept")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(documents(spark, sf_dir))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return left.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_by_next(documents(spark, sf_dir))


def op6_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of the same number: bad means quality 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    outcomes = labels(spark, sf_dir).select("doc_id", 1 - F.col("quality"))
    judged = reputation.judge(pages, outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs, ~is_held_out(F.col("doc_id")))
    found = language.identify(docs, model)
    return found.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(documents(spark, sf_dir), length=50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_BPE)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), BYTE_BPE)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.search(lexical.forward(documents(spark, sf_dir), items), items, k=10)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_jaccard": op2_jaccard,
    "op3_rules": op3_rules,
    "op4_lines": op4_lines,
    "op5_fingerprints": op5_fingerprints,
    "op6_reputation": op6_reputation,
    "op7_language": op7_language,
    "op8_substrings": op8_substrings,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_secrets": op11_secrets,
    "op12_search": op12_search,
    "op13_alignment": op13_alignment,
}

# The same rules and the same shrinkage, level by level.
_SHRINK = """
  SELECT {key}, parent_rate, pages, bad,
         (bad + w * parent_rate) / (pages + w) AS rate, w
  FROM {level} CROSS JOIN (
    SELECT least(greatest(
             coalesce(avg(parent_rate * (1 - parent_rate)) / greatest(
               (sum(pages * pow(bad / pages - parent_rate, 2)) - sum(parent_rate * (1 - parent_rate)))
               / sum(pages), 1e-6) - 1, 1000.0), 2.0), 1000.0) AS w
    FROM {level})"""

_OP6 = f"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM parts),
located AS (
  SELECT page_id,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*'), '') AS path
  FROM cut),
counted AS (
  SELECT host, string_split(host, '.') AS l, count(*) AS pages, sum(1 - quality)::DOUBLE AS bad
  FROM located JOIN labels ON page_id = doc_id
  WHERE host <> '' AND quality IS NOT NULL GROUP BY host),
hosts AS (
  SELECT host, pages, bad,
         CASE WHEN len(l) >= 3 THEN array_to_string(l[-3:], '.') ELSE host END AS domain,
         CASE WHEN len(l) >= 3 THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
  FROM counted),
domains AS (
  SELECT domain, suffix, sum(pages) AS pages, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
s0 AS (
  SELECT suffix, sum(pages) AS pages, sum(bad) AS bad,
         (SELECT (sum(bad) + 0.5) / (sum(pages) + 1) FROM domains) AS parent_rate
  FROM domains GROUP BY suffix),
s1 AS ({_SHRINK.format(key="suffix", level="s0")}),
d0 AS (SELECT domain, d.pages, d.bad, s1.rate AS parent_rate FROM domains d JOIN s1 USING (suffix)),
d1 AS ({_SHRINK.format(key="domain", level="d0")}),
h0 AS (SELECT host, h.pages, h.bad, d1.rate AS parent_rate FROM hosts h JOIN d1 USING (domain)),
h1 AS ({_SHRINK.format(key="host", level="h0")}),
bound AS (
  SELECT host, greatest(0.0, rate - 1.645 * sqrt(rate * (1 - rate) / (pages + w + 1))) AS lower
  FROM h1),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
  END AS rule
  FROM located)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN lower >= 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN bound USING (host)
"""

# All pairs that share a shingle, counted; components by reachability.
_OP2 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, [x for x in string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+') if x <> ''] AS l
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(l) = 0 THEN []
      WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
      ELSE [l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3]
        for i in range(1, len(l) - 2)] END)) AS s
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION SELECT root, b FROM reach JOIN arcs ON node = a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
FROM documents d JOIN reach ON node = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""

# Every 50-byte string of every text, as hexadecimal digits; runs of removed bytes by gaps.
_OP8 = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS i FROM bytes)),
firsts AS (SELECT s, min(doc_id) AS d FROM strings GROUP BY s),
hits AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE doc_id > d),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS fresh
  FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM numbered GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, lo, coalesce(lag(hi) OVER w, 0) AS since, hi
  FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo)),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo)
      || any_value(substr(h, 2 * last + 1)) AS k, sum(hi - lo) AS removed, count(*) AS n
  FROM (SELECT cuts.*, h, max(hi) OVER (PARTITION BY doc_id) AS last FROM cuts JOIN bytes USING (doc_id))
  GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (doc_id)
"""

# Every term of every document and item; integers divide rounding down.
_OP12 = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS total_docs, sum(n)::BIGINT AS total_terms FROM sizes),
found AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * total_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM found, totals GROUP BY term, total_docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(
    w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total_docs) // total_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN found USING (term) JOIN sizes USING (doc_id), totals
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op2_jaccard": _OP2, "op6_reputation": _OP6, "op8_substrings": _OP8, "op12_search": _OP12,
}
