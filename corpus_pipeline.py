"""A training corpus from ``documents``: filter, filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import jaccard_join, mixing, packing, quality_classifier, quality_rules
from tallymark.llm.common import crc_mod, stored, table


def _classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; it learns from the labelled ones among them.

    Null and empty texts are scored as texts without words, repeated rows each
    stay or go, and without labels all scores are one half and all rows stay.
    Columns of any name are carried; an empty table stays empty.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), lambda k: crc_mod(k, 3) != 1)
    name = "score" + "_" * max(map(len, docs.columns))  # no column has it
    scored = quality_classifier.score(docs, model, name=name)
    return scored.where(F.col(name) >= 0.5).select(*[f"`{c}`" for c in docs.columns])


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted of lines, without the lines above the limit.

    Null and empty texts fail the rules; repeated rows stay as often as they
    occur; a null source is a host of its own; an empty table stays empty.
    """
    return quality_rules.kept_documents(docs)


def _join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id, once if its row repeats.

    Null and empty texts and rows with a null id link with nothing and stay;
    an empty table stays empty.
    """
    return jaccard_join.one_of_each(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, up to three times.

    Texts without words take no words but may stay; a null source is one
    source; ties of size are ordered by id; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null or empty text is its end id, an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", _classifier),
    ("quality_rules", _rules),
    ("jaccard_join", _join),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: A fitted model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
