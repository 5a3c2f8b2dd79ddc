"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as op2
from tidemark.llm import filter_audit as op13
from tidemark.llm import html_extract as op7
from tidemark.llm import language_id as op5
from tidemark.llm import licence_scan as op6
from tidemark.llm import near_duplicates as op10
from tidemark.llm import packing as op11
from tidemark.llm import sentence_pieces as op8
from tidemark.llm import substring_dedup as op4
from tidemark.llm import token_alignment as op12
from tidemark.llm import token_counts as op3
from tidemark.llm import toxicity as op1
from tidemark.llm import vector_search as op9
from tidemark.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    open_rows = documents.where(~op5.held_out("doc_id", 4, 2))
    model = op1.fit(open_rows, table(spark, sf_dir, "labels"), F.crc32(F.col("id").cast("string").cast("binary")) % 4)
    return op1.predict(documents.withColumn("held_out", op5.held_out("doc_id", 4, 2)), model, keep=["doc_id", "held_out"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op2.digest(op2.match(documents, table(spark, sf_dir, "benchmark")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.repeats(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", op5.held_out("doc_id", 3, 1))
    net = op5.fit(documents.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return op5.predict(documents, net, keep=["doc_id", "held_out"])


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.licence_scan(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return op7.html_text(pages, op7.fit(pages), keep=["page_id", "url"])


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return op9.exact_top_k(vectors, F.col("vec_id") % 20 == 0).drop("query_row")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.classes(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.align(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {q.__name__: q for q in (op1_toxicity, op2_decontaminate, op3_token_counts, op4_substring_dedup, op5_language_id, op6_licence_scan, op7_html_extract, op8_sentence_pieces, op9_vector_search, op10_near_duplicates, op11_packing, op12_token_alignment, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": op2.sql(), "op6_licence_scan": op6.sql(), "op9_vector_search": op9.sql(), "op13_filter_audit": op13.sql()}
