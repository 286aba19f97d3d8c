"""Registered queries of the operators: name -> Spark query, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import alignment, decontaminate, jaccard_join, licenses, mixing, quality_rules, secrets, sharding, token_counts, token_files, turns, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return deco


@query("op9_quality_rules", quality_rules.oracle())
def op9_quality_rules(spark, sf_dir):
    """Rule ledger of every document with the base and the policy verdict."""
    return quality_rules.digest(table(spark, sf_dir, "documents"))


@query("op8_mix_sources", mixing.oracle())
def op8_mix_sources(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.digest(table(spark, sf_dir, "documents"))


@query("op1_shard_documents")
def op1_shard_documents(spark, sf_dir):
    """Shard and slot of every document under a uniform shuffle into 16 shards of equal counts."""
    return sharding.digest(table(spark, sf_dir, "documents"))


@query("op4_decontaminate", decontaminate.oracle())
def op4_decontaminate(spark, sf_dir):
    """Words of every document that stand in a window of the benchmark."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    """Shingle count and near-duplicate component of every document."""
    return jaccard_join.digest(table(spark, sf_dir, "documents"))


@query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    """Host, path, fitting rule and verdict of every page's URL."""
    return url_filter.digest(table(spark, sf_dir, "pages"))


@query("op3_warc_salvage", warc.ORACLE)
def op3_warc_salvage(spark, sf_dir):
    """Every page's record, written to WARC archives and read back by the salvage reader."""
    return warc.digest(table(spark, sf_dir, "pages"))


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    """Secrets in every document: base kinds and structurally confirmed ones."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op7_license_scan", licenses.oracle())
def op7_license_scan(spark, sf_dir):
    """License phrases and notices in every document."""
    return licenses.digest(table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Tokens of every document under the unigram segmentation."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query("op13_token_files")
def op13_token_files(spark, sf_dir):
    """Place, length and checksum of every document's token ids, read back from token files."""
    return token_files.digest(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    """Groups and links between the tokens of two vocabularies in every document."""
    return alignment.digest(table(spark, sf_dir, "documents"))


@query("op12_repair_conversations")
def op12_repair_conversations(spark, sf_dir):
    """Faults and the cheapest repair of every damaged conversation."""
    return turns.digest(table(spark, sf_dir, "conversations"))
