"""The pipeline over `documents`: toxicity, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage takes what the one before it kept, as Parquet written to and read from the shared folder, and hands on the columns of
`documents`; the last adds what the mix takes of each document.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causal_panel.llm import decontam, jaccard, mixing, surrogates, toxicity
from causal_panel.llm.common import settle, table
from causal_panel.llm.queries import SURROGATE_KEY, source_weight

#: No SQL: a trained classifier, keyed surrogates and a random rounding can't be written in it; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels of what it is given."""
    return toxicity.clean_only(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8), that with the smallest id.

    op3's fingerprints, linked by its trie self-join, propose; MinHash bands propose what differs in more bits; exact sets confirm."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by surrogates."""
    return surrogates.replace_entities(docs, SURROGATE_KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document."""
    return mixing.mix(docs, source_weight())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
