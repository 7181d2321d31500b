"""The corpus pipeline: each stage reads what the stage before it kept and wrote, and calls one operator on all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import queries as q
from barloom.llm.benchmark import drop_leaks
from barloom.llm.jaccard import near_duplicates
from barloom.llm.line_dedup import dedup_lines
from barloom.llm.quality import fit_quality, judge_notes
from barloom.session import materialize


def _documents(notes: DataFrame) -> DataFrame:
    return notes.withColumnsRenamed({"position_id": "doc_id", "note": "text"})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the likelihood ratio."""
    model = fit_quality(q.as_notes(docs), q.reviews(spark, sf_dir))
    return _documents(judge_notes(q.as_notes(docs), model).filter("kept").select(*q.as_notes(docs).columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the blocks of lines that an earlier one holds; n_chars follows the text."""
    cut = _documents(dedup_lines(q.as_notes(docs)))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    groups = near_duplicates(q.as_notes(docs), words=5, percent=80)
    gone = groups.filter("component <> position_id").select(F.col("position_id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return _documents(drop_leaks(q.as_notes(docs), q.table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences."""
    return q.packed(q.as_notes(docs))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram jaccard join", near_duplicate),
          ("benchmark decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None   # scoring, alignment and tokenizing are not SQL; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
