"""From raw documents to packed sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscore.llm import decontaminate, language, near_text, packing, substring
from tabscore.llm.tables import Scratch, documents, texts_of
from tabscore.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Hashes, trees and a tokenizer: no SQL states the packed rows, so tests compare stage by stage with brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))


def _same(left: DataFrame, right: DataFrame):
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_hash == right.text_hash)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null or have no letter go."""
    found = language.identify(docs.select(*COLUMNS), COLUMNS)
    return found.filter(F.col("lang_pred") != language.UNDECIDED).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more).

    It is the one of the smallest doc_id; rows that repeat doc_id and text are one.
    """
    found = near_text.near_duplicates(docs, shingle=5, percent=80)
    kept = found.filter("representative").groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    kept = Scratch(spark, "near-dedup").save(kept, "kept")
    rows, once, more = _keyed(docs), kept.filter("copies = 1"), kept.filter("copies > 1")
    out = rows.join(texts_of(once), _same(rows, once), "left_semi")
    if not more.isEmpty():
        out = out.union(rows.join(texts_of(more), _same(rows, more), "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return out.select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their words in runs of 35 or more that start elsewhere too.

    Other texts stay as they are; a document with no word left goes. n_chars is
    counted anew where words went.
    """
    cut = substring.cut_repeats(substring.find_repeats(docs)).dropDuplicates(["doc_id", "text_hash"])
    rows = _keyed(docs)
    joined = rows.join(texts_of(cut), _same(rows, cut), "left")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(rows.text)
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(rows.n_chars)
    out = joined.filter((F.coalesce("n_removed", F.lit(0)) == 0) | (F.col("kept") != ""))
    return out.select(rows.doc_id, text.alias("text"), "lang", "source", chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = leaks.select("doc_id", "text_hash").distinct()
    rows = _keyed(docs)
    return rows.join(texts_of(leaks), _same(rows, leaks), "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; see ``packing.pack_documents``."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
