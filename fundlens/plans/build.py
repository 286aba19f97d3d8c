"""Composed pipelines over the panel: the minimum slice and E2/X7 ``build_features``.

X7 plan shape: the panel ``groupBy`` (one Exchange), then one Exchange on ``fund_cnpj`` that serves
the cleaning flags (C2, C3, C4), every per-(dataset, fund) feature window and the fund aggregation:
hash partitioning on the fund satisfies the clustering on (dataset, fund).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_divide, stddev_samp
from ..operators.aggregate import aggregate_features, dropna_any
from ..operators.clean import CleanConfig, clean
from ..operators.features import DEFAULT_WINDOWS, create_features
from ..operators.split import split_labeled
from .views import panel


def sharpe_by_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: per fund mean and std of the daily return and their ratio (Sharpe)."""
    daily = create_features(panel(spark, sf_dir), ["returns"], dedupe=False)
    out = daily.groupBy("fund_cnpj").agg(F.avg("return").alias("mean_return"),
                                         stddev_samp("return").alias("std_return"))
    return out.withColumn("sharpe", safe_divide("mean_return", "std_return"))


def build_features(panel_df: DataFrame, config: CleanConfig, val_cutoff: str, train_test_cutoff: str,
                   windows=DEFAULT_WINDOWS, boundary: str = "reference", corr_mode: str = "pairwise",
                   drop_threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Clean -> split (dataset column) -> daily features per (dataset, fund) -> fund features.

    Returns (daily, fund_level); both carry ``dataset``. Windows restart at each split's start,
    as in the reference (history before a cutoff is not visible to the next split)."""
    cleaned = clean(panel_df, config)
    labeled = split_labeled(cleaned, val_cutoff, train_test_cutoff, boundary=boundary)
    daily = create_features(labeled, windows=windows, by=["dataset"], dedupe=False)
    fund = aggregate_features(daily, windows=windows, by=["dataset"], corr_mode=corr_mode,
                              drop_threshold=drop_threshold)
    return daily, fund


def experiment_input(fund_level: DataFrame) -> DataFrame:
    """A9 on the fund-level table: the rows the clustering experiments use."""
    return dropna_any(fund_level)
