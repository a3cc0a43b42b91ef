"""A corpus pipeline in five stages, each one of the numbered operators.

Every stage works on all rows that its predecessor kept.  The first four return
the columns of ``documents``, with any others that the table has, whatever their
names; the last returns the token ids of what is left.

Null and empty texts have no words, so the first stage rejects them; where a
stage is used alone, they have no lines to lose, are no near copies, hold no
benchmark passage, and have no tokens.  Rows with a null id are judged by their
text as all others, and none is another's near copy.  Of rows that share an id
the near-copy stage keeps one at most; the other stages judge each by its own
text, repeated rows alike.  Very long texts are read whole.  An empty table
stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontamination, jaccard_join, line_dedup, quality_rules
from tessera.llm.common import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule cascade rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; every document stays."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document left."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", tokens),
]

#: SQL can't express the Jaccard join or BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
