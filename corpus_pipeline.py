"""The corpus pipeline: stages that each read what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame with the columns of docs
(the last adds the columns of the mix). run() applies them to documents, writing each result to the shared folder and deleting what its making left there.

* Null, empty and blank texts are rejected by the quality rules, whose result is that every document left has words. Without labels all others stay.
* Ties: rows are ordered by doc_id (null last), then by a hash of the text. Repeated rows are one document: they stay or go together, and each is in the mix as itself.
* An empty table gives an empty result. Columns beyond those of documents pass through, but for those named like a column of the mix.
* doc_id must be an integer type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm import decontaminate, line_dedup, mixing, near_dup, quality_rules
from quillmatch.llm.common import Scratch, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_documents(docs, quality_rules.fit(spark, docs, read_table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out; a document left without a line of its own goes."""
    cut = line_dedup.keep_lines(docs, Scratch(spark))
    return cut.where("n_removed = 0 or n_left > 0").select("row.*")


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first document stays.

    Texts are compared as they are in documents, before lines were cut out of them: of two near copies the second has lost the lines that it shares with the first.
    The documents left are then compared by what they hold: two may be near copies but for lines that were cut out.
    """
    return near_dup.keep_documents(docs, Scratch(spark), whole=read_table(spark, sf_dir, "documents"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.keep_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slots in the mix of sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
]

#: Classifiers, fingerprints and hashed n-grams are beyond SQL; tests/llm/test_pipeline.py holds each stage of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark)
    before, made = None, len(Scratch.made)
    for _, stage in STAGES[:-1]:
        now = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
        Scratch.clear(made)
        docs = before = now
    return STAGES[-1][1](spark, docs, sf_dir)
