"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; its rows are written and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seclake.llm import contamination, lines, mixing, near_copies, toxicity
from seclake.llm.blocks import read_table
from seclake.llm.queries import TOXIC_FROM
from seclake.llm.tables import stored

SIMILAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC_FROM or more go. Trained as op5 is."""
    return toxicity.without_toxic(
        docs, read_table(spark, sf_dir, "labels"), TOXIC_FROM,
        toxicity.remainder(F.col("doc_id"), 3) != 1)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or is one word from, go out of the texts."""
    return lines.with_kept_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_copies.one_of_each(docs, SIMILAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.without_matches(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with copies, how often, and n_words, the words of one."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

# Trees learnt from labels are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
