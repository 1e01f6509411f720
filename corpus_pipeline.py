"""A corpus from raw documents to packed training sequences.

Each stage takes the documents its predecessor kept and returns those it keeps
(the last returns the packed pieces); its output is written as Parquet in the
shared folder and read again, so a lost executor costs a part of one stage.

Edge cases, beyond those of the operators: a stage that removes nothing returns
its input; rows that repeat an id, or have none, are judged one by one in the
near-duplicate stage, and one of several equal rows stays; a document that loses all its lines to earlier documents goes with them,
one that had no text stays; documents without a label are judged like others;
empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.llm.common import stored, table
from rolloutlab.llm.decontaminate import uncontaminated
from rolloutlab.llm.line_dedup import dedup_lines
from rolloutlab.llm.minhash_dedup import one_of_each
from rolloutlab.llm.packing import pack
from rolloutlab.llm.quality import accepted, document_statistics, learn
from rolloutlab.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant learned from the labels does not reject."""
    stats = stored(document_statistics(docs), "statistics")
    return accepted(docs, learn(stats, table(spark, sf_dir, "labels", "doc_id", "quality")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that resemble an earlier line; documents left without any text go."""
    out = dedup_lines(docs).where("__n_removed = 0 OR trim(BOTH ' \\t\\r\\n' FROM text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its place in a sequence of at most 4096 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), kind="word")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The stages learn a model, hash, verify and pack: plain SQL cannot express them (tests hold them against brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
