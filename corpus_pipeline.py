"""The training-data pipeline: five stages over ``documents``, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet under
the shared folder and rereads it as the next stage's ``docs``. All but the last return the columns
of ``documents``; the last adds ``shard`` and ``slot``. The fourth stage repeats a document for
each copy that the mix takes; sharding treats the copies as rows of their own.

Defined cases: a null or empty text fails the quality rules; null ids and sources are kept, and of
near copies without an id one stays, as of those with one; rows that repeat an id with another text
are documents of their own, those that repeat both are one document repeated and stay or go together;
an empty table gives an empty result with all columns; further columns pass through all stages, and
those named ``shard`` or ``slot`` get an underscore in front in the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fundlens.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from fundlens.llm.queries import table
from fundlens.session import ship_package, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy accepts."""
    return quality_rules.keep(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that with the smallest id."""
    ship_package(spark)
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each copy."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharding.shuffle_to_shards(docs, 16)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources", mixture), ("sharding", shards)]

# near-duplicate components and the drawn shards are not SQL: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
