"""Preprocessing fitted on the train split and applied to every split.

Inputs are one DataFrame with a ``dataset`` column. Fitting collects only fitted scalars (per-column
quantiles, a d x d principal-axes matrix); transforms are plain column expressions, so they stay in
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA as SparkPCA
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# fixed values: the clustering matrix of the reference experiments
LOOK_FEATURES = ["mean_return", "median_return", "std_return", "avg_time_drawdown", "sharpe", "max_drawdown"]
DATASET = "dataset"


def _train(df: DataFrame, dataset_col: str, fit_on: str) -> DataFrame:
    return df.where(F.col(dataset_col) == fit_on) if dataset_col in df.columns else df


def _keep(df: DataFrame, cols: Sequence[str], features: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in features and c in cols]


def just_filter(df: DataFrame, features: Sequence[str] = LOOK_FEATURES,
                keep: Sequence[str] = ("fund_cnpj", DATASET)) -> DataFrame:
    """Project the feature columns (plus key columns)."""
    return df.select(*[c for c in keep if c in df.columns], *features)


def check_matrix(df: DataFrame, features: Sequence[str] = LOOK_FEATURES, dataset_col: str = DATASET,
                 fit_on: str = "train") -> None:
    """Every feature present and numeric; no NULL/NaN in the fitting split (one count job)."""
    types = dict(df.dtypes)
    missing = [c for c in features if c not in types]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    bad = [c for c in features if types[c] not in ("double", "float", "int", "bigint", "smallint", "decimal")]
    if bad:
        raise ValueError(f"non-numeric feature columns: {bad}")
    cond = F.lit(False)
    for c in features:
        cond = cond | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    if _train(df, dataset_col, fit_on).where(cond).limit(1).count():
        raise ValueError("the fitting split has null or NaN features; fill or drop them before scaling")


def fit_robust_scaler(df: DataFrame, features: Sequence[str] = LOOK_FEATURES, dataset_col: str = DATASET,
                      fit_on: str = "train") -> dict[str, tuple[float, float]]:
    """P2 fit: per column (median, q75 - q25) on the fitting split, exact and interpolated;
    a (near-)zero range becomes 1."""
    q = exact_quantiles(_train(df, dataset_col, fit_on), features, [0.25, 0.5, 0.75])
    eps = np.finfo(np.float64).eps
    params = {}
    for c in features:
        if q[(c, 0.5)] is None:
            raise ValueError(f"no values to fit column {c}")
        scale = q[(c, 0.75)] - q[(c, 0.25)]
        params[c] = (q[(c, 0.5)], 1.0 if scale < 10 * eps else scale)
    return params


def apply_robust_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c) if c in params
                       else F.col(c) for c in df.columns])


def robust_scale(df: DataFrame, features: Sequence[str] = LOOK_FEATURES, dataset_col: str = DATASET,
                 fit_on: str = "train", keep: Sequence[str] = ("fund_cnpj", DATASET)) -> DataFrame:
    """Centre by the train median, divide by the train IQR; applied to every split."""
    x = just_filter(df, features, keep)
    return apply_robust_scaler(x, fit_robust_scaler(x, features, dataset_col, fit_on))


def fit_pca(df: DataFrame, features: Sequence[str] = LOOK_FEATURES, k: int | None = None,
            dataset_col: str = DATASET, fit_on: str = "train") -> dict:
    """P3 fit with Spark ML on the fitting split: mean (StandardScaler withMean) and principal axes
    (ml.feature.PCA on the centred vectors). Signs follow a fixed rule: the largest |loading| of
    every axis is positive."""
    train = _train(df, dataset_col, fit_on)
    vec = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train.select(*features))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_xc").fit(vec)
    n = train.count()
    k = k or min(len(features), n)
    model = SparkPCA(k=k, inputCol="_xc", outputCol="_p").fit(scaler.transform(vec))
    pc = model.pc.toArray().copy()  # d x k
    for j in range(pc.shape[1]):
        i = int(np.argmax(np.abs(pc[:, j])))
        if pc[i, j] < 0:
            pc[:, j] = -pc[:, j]
    return {"features": list(features), "mean": scaler.mean.toArray().tolist(), "pc": pc.tolist(),
            "explained_variance_ratio": model.explainedVariance.toArray().tolist()}


def apply_pca(df: DataFrame, fitted: dict, keep: Sequence[str] = ("fund_cnpj", DATASET)) -> DataFrame:
    feats, mean, pc = fitted["features"], fitted["mean"], np.array(fitted["pc"])
    cols = []
    for j in range(pc.shape[1]):
        e = None
        for i, c in enumerate(feats):
            term = (F.col(c) - F.lit(mean[i])) * F.lit(float(pc[i, j]))
            e = term if e is None else e + term
        cols.append(e.alias(f"pca_{j + 1}"))
    return df.select(*[c for c in keep if c in df.columns], *cols)


def pca(df: DataFrame, features: Sequence[str] = LOOK_FEATURES, k: int | None = None,
        dataset_col: str = DATASET, fit_on: str = "train", keep: Sequence[str] = ("fund_cnpj", DATASET)
        ) -> DataFrame:
    """Project every split on the train principal axes (columns pca_1..pca_k)."""
    return apply_pca(df, fit_pca(df, features, k, dataset_col, fit_on), keep)


def pca_scaling(df: DataFrame, features: Sequence[str] = LOOK_FEATURES, dataset_col: str = DATASET,
                fit_on: str = "train", keep: Sequence[str] = ("fund_cnpj", DATASET)) -> DataFrame:
    """P2 then P3 (both fitted on train)."""
    scaled = robust_scale(df, features, dataset_col, fit_on, keep)
    return pca(scaled, features, None, dataset_col, fit_on, keep)


def pre_processing(n_components: int, df: DataFrame, features: Sequence[str] = LOOK_FEATURES,
                   dataset_col: str = DATASET) -> DataFrame:
    """P5: the reference fits a PCA and then discards it, so the result is P2 (robust scaling)."""
    return robust_scale(df, features, dataset_col)


# Named preprocessing steps for the experiment grid (name -> function(df) -> transformed df).
PREPROCESSING = {
    "just_filter": lambda df, feats=LOOK_FEATURES: just_filter(df, feats),
    "scalling": lambda df, feats=LOOK_FEATURES: robust_scale(df, feats),
    "PCA": lambda df, feats=LOOK_FEATURES: pca(df, feats),
    "PCA_scalling": lambda df, feats=LOOK_FEATURES: pca_scaling(df, feats),
}
