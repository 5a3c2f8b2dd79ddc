"""From documents to token ids: language ID, near-dedup, dedup of repeated strings, decontamination, SentencePiece ids.

Each stage works on what the one before kept, written as Parquet in the shared folder and read again. Each gives no rows for an
empty table and takes very long texts whole; all but the last keep the columns of documents, other columns among them. Rows of a
null id: language_id leaves those of a known language, near_duplicates all of them, and substring_dedup cuts nothing from them.
Null and empty texts have no language, so they go in the first stage; later stages would let them pass. Rows that repeat an id and
text are one after near_duplicates. Ties: the first language in order, the least id of a class, the smallest id of equal strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, near_duplicates, sentence_pieces, substring_dedup
from tidemark.llm.common import table
from tidemark.session import scratch, ship

#: A document whose language is less likely than this, or that has no letter, is rejected.
LEAST_LANGUAGE_SCORE = 0.4
#: A document of whose words more than this share is benchmark text goes; of the others the benchmark's spans go.
MOST_BENCHMARK_COVERAGE = 0.5

ORACLE_SQL = None  # a trained network and sampled sketches are beyond SQL; the tests hold the stages against brute force


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows teach."""
    ship(spark)
    known = docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out("doc_id", 3, 1))
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}  # what is added may bear a name of theirs
    plain = docs.select(*(F.col(c).alias(n) for n, c in names.items()))
    found = language_id.predict(plain, language_id.fit(known), text=f"c{docs.columns.index('text')}")
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*(F.col(n).alias(c) for n, c in names.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id."""
    ship(spark)
    return near_duplicates.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that documents of smaller ids have."""
    ship(spark)
    return substring_dedup.without_repeats(docs)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), most_coverage=MOST_BENCHMARK_COVERAGE)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of each document."""
    ship(spark)
    return sentence_pieces.encode(docs).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", decontaminate_texts),
    ("sentence_pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
