"""A corpus pipeline of five stages: toxicity, line dedup, near-dedup, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), keeps the columns of docs (all but the last) and is written as Parquet and read
again before the next one. The last one returns the training order: documents with epoch, block and slot.

Defined results of every stage: an empty table gives no rows; a null or empty text is clean, has no repeated lines and no near copy, and is
dealt like any other; very long texts are handled whole; repeated rows are rows of their own, of which near-dedup keeps one if they have words;
extra columns pass through whatever their names, but for names that begin with two underscores; the last stage has
columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import decontaminate, linededup, mixing, neardup, toxicity
from wakeline.llm._common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the compression classifier predicts toxic; with labels of one kind or none, by their share alone."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document or line has, up to one to five edits by length; documents of which nothing is left go. Ties go to the smaller doc_id, then line; a null doc_id comes last."""
    return linededup.without_repeated_lines(docs, shortest=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest id, of each group that shares 0.8 of its five-word shingles; of rows with one id the first as read, a null id last."""
    return neardup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item, or all words of a shorter one; row by row."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of a temperature mixture of the sources, in blocks; a null source is the source ""."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources)]

#: Compression lengths and min-wise hashes can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
