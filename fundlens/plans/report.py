"""The experiment grid and its report (A9 -> M9 -> S12 -> M10 -> M11 -> M12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators.cluster import CONFIG, run_all_experiments
from ..operators.preprocess import LOOK_FEATURES
from ..session import scratch_path, write_table
from ..sources.files import write_csv
from .build import experiment_input


def run_and_report(fund_features: DataFrame, models: Sequence[str | tuple[str, dict]] = ("KMeansTrainer", "GMMTrainer"),
                   clusters: Sequence[int] = (2, 3, 4, 5),
                   preprocessing: Sequence[str] = ("just_filter", "scalling", "PCA", "PCA_scalling"),
                   csv_path: str | None = None, metrics: Sequence[str] = (*LOOK_FEATURES, "cluster_size")) -> DataFrame:
    """The whole grid fitted and evaluated, its result table (a few rows per configuration) written as
    CSV, and the stability of the selected configuration: a row per metric with the distances, the
    configuration's name and the number of rows that share the best validation silhouette."""
    spark = fund_features.sparkSession
    results = write_table(run_all_experiments(experiment_input(fund_features), models, clusters, preprocessing), "results")
    write_csv(results, csv_path or scratch_path(spark, "results-csv"), allow_full_csv=True)
    chosen = write_table(EV.select_config(results), "chosen")
    name = chosen.select(*CONFIG).limit(1)
    best = EV.best_by_silhouette(results).agg(F.count(F.lit(1)).alias("n_best"))
    report = EV.stability_report(chosen, metrics)
    return report.crossJoin(F.broadcast(name)).crossJoin(F.broadcast(best))  # one-row sides
