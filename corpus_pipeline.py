"""A training corpus from raw documents, in five stages that each decide for the next one.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of the documents table; a text that a stage changes gets its new
number of characters. Documents that a stage leaves without a word go. Rows
with a null text are rejected by the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.llm import jaccard, language, lines, packing, substrings
from logvane.llm.common import is_held_out
from logvane.session import checkpoint_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Word shingles of five and a similarity of 0.8: what near duplicates are throughout.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
REPEAT_BYTES = 50


def _with_words(docs: DataFrame) -> DataFrame:
    """Documents that still have a word, with their characters counted again."""
    counted = docs.withColumn("n_chars", F.length("text").cast("long"))
    return counted.where(F.col("text").rlike(r"\S")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told; the known languages train the model."""
    model = language.fit(docs, ~is_held_out(F.col("doc_id")))
    return language.known_only(docs.select(*COLUMNS), model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each group of equal or similar lines."""
    return _with_words(lines.without_repeats(docs.select(*COLUMNS)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near duplicates."""
    return jaccard.representatives(docs.select(*COLUMNS), SHINGLE_WORDS, SIMILARITY_PERCENT)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out strings of 50 bytes and more that stand in a document of smaller id."""
    return _with_words(substrings.without_repeats(docs.select(*COLUMNS), REPEAT_BYTES))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token sequences; one row for each piece, with its ids."""
    return packing.pack_documents(docs, WORD_BPE, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

# Language model, MinHash bands and tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
