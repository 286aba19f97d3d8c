"""Clustering models and the experiment grid.

Single models (M1-M3) are Spark ML estimators fitted on the train split; labels for every split come
from one ``transform``. The grid (M9), the parameter search (M7) and the backward selection (M13) fit
all their configurations at once (``batched``): the points of every preprocessing or feature subset
are stacked, an iteration is one scan for all fits, and all labelings are evaluated in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .batched import KMEANS, MIXTURE, Fit, fit_all, label_all
from .evaluate import BLOCK_ROWS, evaluate_clusters, silhouette
from .preprocess import DATASET, LOOK_FEATURES, PREPROCESSING

FIT_TASK_ROWS = 10_000       # rows of a task in a step of a single model's fit


@dataclass
class ModelSpec:
    """A named model: ``kind`` and parameters of a batched fit, or ``label(x, k)``, which labels every
    row by a rule fitted on the train rows (adds ``pred``)."""
    name: str
    kind: str | None = None
    params: dict = field(default_factory=dict)
    label: Callable[[DataFrame, int], DataFrame] | None = None


def kmeans(k: int = 2, seed: int = 0, max_iter: int = 300) -> KMeans:
    """M1: k-means (k-means|| initialisation, seeded)."""
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="pred")


def gmm(k: int = 2, seed: int = 0, max_iter: int = 100, tol: float = 1e-3) -> GaussianMixture:
    """M2: Gaussian mixture with full covariances (``n_clusters`` is ``k``). ``batched`` has several
    starts (``n_init``)."""
    return GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="_features",
                           predictionCol="pred", probabilityCol="_prob")


MODELS = {"KMeansTrainer": ModelSpec("KMeansTrainer", KMEANS), "GMMTrainer": ModelSpec("GMMTrainer", MIXTURE),
          "QuantileBins": ModelSpec("QuantileBins", label=lambda x, k: quantile_bins(x, "sharpe", k))}
# parameter names of other libraries' estimators
ALIASES = {"n_clusters": "k", "n_components": "k", "random_state": "seed", "reg_covar": "reg"}


def fit_of(model: str, name: str, space: str, **params) -> Fit:
    """The batched fit of a named model with keyword parameters."""
    spec = MODELS[model]
    given = {ALIASES.get(p, p): v for p, v in {**spec.params, **params}.items()}
    return Fit(name, space, spec.kind, **given)


def quantile_bins(df: DataFrame, col: str, k: int, dataset_col: str = DATASET, fit_on: str = "train",
                  out: str = "pred") -> DataFrame:
    """A deterministic baseline: the label is the number of exact train quantiles i / k of ``col``
    (i = 1..k-1) that lie below the value. ``df`` is scanned several times: pass a written table."""
    from .quantiles import exact_quantiles

    cuts = exact_quantiles(df.where(F.col(dataset_col) == fit_on), [col], [i / k for i in range(1, k)], materialize=False)
    return df.withColumn(out, sum(((F.col(col) > F.lit(q)).cast("int") for q in cuts.values()), F.lit(0)))


def _features_of(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys and c != "pred"]


def in_few_tasks(rows: DataFrame, task_rows: int | None = None) -> DataFrame:
    """``rows`` in tasks of about ``task_rows`` rows. The funds' rows are few but lie in a file for every
    task that wrote them, and an iterative fit runs all tasks anew in each of its steps."""
    return rows.coalesce(max(1, -(-rows.count() // (task_rows or FIT_TASK_ROWS))))


def fit_train_predict_all(x: DataFrame, estimator, features: Sequence[str] | None = None,
                          dataset_col: str = DATASET, fit_on: str = "train",
                          keys: Sequence[str] = ("fund_cnpj", DATASET)) -> DataFrame:
    """M3: fit on the train rows, label every row (``pred`` int) with one transform. ``x`` is scanned
    several times: pass a written table or columns of one."""
    feats = list(features) if features else _features_of(x, keys)
    vec = VectorAssembler(inputCols=feats, outputCol="_features").transform(x)
    model = estimator.fit(in_few_tasks(vec.where(F.col(dataset_col) == fit_on)))
    out = model.transform(vec)
    return out.select(*x.columns, F.col("pred").cast("int").alias("pred"))


def assign_to_centroids(df: DataFrame, vector_col: str, centroids: DataFrame, out: str = "pred") -> DataFrame:
    """Label of the nearest centre by squared Euclidean distance (smallest label on ties).
    ``centroids`` (label, centre array) is a fitted model, a row per cluster: it becomes one array
    literal, and the nearest is the smallest (distance, label) struct, so the expression does not
    grow with the number of clusters."""
    rows = [(r["label"], [float(v) for v in r["centre"]]) for r in centroids.orderBy("label").collect()]
    model = F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(c).alias("centre")) for lab, c in rows])
    distance = lambda c: F.aggregate(F.zip_with(F.col(vector_col), c["centre"], lambda u, v: (u - v) * (u - v)),
                                     F.lit(0.0), lambda t, d: t + d)
    nearest = F.array_min(F.transform(model, lambda c: F.struct(distance(c).alias("d"), c["label"].alias("label"))))
    return df.withColumn(out, F.when(F.col(vector_col).isNotNull(), nearest["label"]))


CONFIG = ("model", "n_clusters", "preprocessing")


def stacked_points(spaces: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(space, x, keys) of all spaces, written: each space's features as one array."""
    out = None
    for name, x in spaces.items():
        one = x.select(F.lit(name).alias("space"), F.array(*[F.col(c).cast("double") for c in _features_of(x, keys)]).alias("x"), *keys)
        out = one if out is None else out.unionByName(one)
    return write_table(out, "points")


def train_points(points: DataFrame, key: str, dataset_col: str | None, fit_on: str) -> DataFrame:
    """(space, key, x) of the rows to fit on, those with a missing feature left out."""
    rows = points if dataset_col is None else points.where(F.col(dataset_col) == fit_on)
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    return write_table(rows.where(whole).select("space", F.col(key).cast("string").alias("key"), "x"), "train-points")


def labelings(raw: DataFrame, models: Sequence[str | tuple[str, dict]], clusters: Sequence[int], preprocessing: Sequence[str],
              look_features: Sequence[str], key: str, dataset_col: str, fit_on: str = "train") -> DataFrame:
    """Every configuration's labels, stacked and written: key, dataset, pred, the transformed features
    as one array, and the configuration's names. All fits run in two loops of scans."""
    spaces = {p: PREPROCESSING[p](raw, list(look_features)) for p in preprocessing}
    points = stacked_points(spaces, (key, dataset_col))
    named = [(m, {}) if isinstance(m, str) else m for m in models]
    config = {f"{m}|{k}|{p}": (m, k, p, params) for m, params in named for k in clusters for p in preprocessing}
    fits = [fit_of(m, name, p, k=k, **params) for name, (m, k, p, params) in config.items() if MODELS[m].kind]
    parts = []
    if fits:
        labeled = label_all(points, fit_all(train_points(points, key, dataset_col, fit_on), fits), [f.name for f in fits], (key, dataset_col))
        part = lambda i: F.split("fit", r"\|")[i]
        parts.append(labeled.select(key, dataset_col, "pred", "x", part(0).alias("model"), part(1).cast("int").alias("n_clusters"), part(2).alias("preprocessing")))
    for m, k, p, _ in config.values():
        if not MODELS[m].kind:
            x = spaces[p]
            parts.append(MODELS[m].label(x, k).select(key, dataset_col, "pred", F.array(*[F.col(c).cast("double") for c in _features_of(x, (key, dataset_col))]).alias("x"),
                                                      F.lit(m).alias("model"), F.lit(k).alias("n_clusters"), F.lit(p).alias("preprocessing")))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return write_table(out, "labelings")


def run_all_experiments(fund_features: DataFrame, models: Sequence[str | tuple[str, dict]] = ("KMeansTrainer", "GMMTrainer"),
                        clusters: Sequence[int] = (2, 3, 4, 5),
                        preprocessing: Sequence[str] = ("just_filter", "scalling", "PCA", "PCA_scalling"),
                        look_features: Sequence[str] = LOOK_FEATURES, key: str = "fund_cnpj",
                        dataset_col: str = DATASET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """M9: every (model, k, preprocessing) fitted on train and evaluated on train, test and
    validation; the stacked labelings are evaluated in one pass (M4). A model is a name, or a name and
    keyword parameters such as ``("GMMTrainer", {"n_init": 5})``."""
    raw = write_table(fund_features.dropna(subset=list(look_features)), "experiment-rows")
    labeled = labelings(raw, models, clusters, preprocessing, look_features, key, dataset_col)
    raw_pred = raw.select(key, dataset_col, *look_features).join(labeled.drop("x"), [key, dataset_col])
    return evaluate_clusters(raw_pred, labeled, look_features, key, by=[*CONFIG, dataset_col], block_rows=block_rows,
                             labelings=["model", "n_clusters"])


SAME_SCORE = 1e-12  # scores of equal labelings differ by the order of their sums at most


def param_search(x: DataFrame, model: str, param_grid: Sequence[dict], key: str = "fund_cnpj",
                 features: Sequence[str] | None = None) -> tuple[dict | None, float, DataFrame | None]:
    """M7: all parameter sets fitted at once on all rows and scored by one stacked exact silhouette;
    the first strictly best wins. Returns (params, score, labels)."""
    feats = list(features) if features else [c for c in x.columns if c != key]
    if not param_grid:
        return None, float("-inf"), None
    points = stacked_points({"all": x.select(key, *feats)}, (key,))
    fits = [fit_of(model, str(i), "all", **params) for i, params in enumerate(param_grid)]
    labels = write_table(label_all(points, fit_all(train_points(points, key, None, ""), fits), [f.name for f in fits], (key,)), "search")
    scores = {r["fit"]: r["silhouette_score"] for r in silhouette(labels, "pred", "x", key, by=["fit"], labelings=["fit"]).collect()}   # a row per set
    best, best_score = None, float("-inf")
    for i in range(len(fits)):
        score = scores.get(str(i))
        if score is not None and score > best_score + SAME_SCORE:
            best, best_score = i, score
    if best is None:
        return None, best_score, None
    own = labels.where(F.col("fit") == str(best)).select(key, "pred")
    return dict(param_grid[best]), best_score, x.join(own, key)


WORST = -1e9  # fixed value: the score of a labeling with fewer than two clusters


def score_subsets(x: DataFrame, model: str, k: int, subsets: dict[str, list[str]], key: str, dataset_col: str,
                  fit_on: str, score_on: str) -> DataFrame:
    """(subset, score): for each named feature subset the exact silhouette of the scored split. The
    subsets are fitted at once, and their labelings scored in one pass."""
    keys = (key, dataset_col)
    if MODELS[model].kind:
        points = stacked_points({name: x.select(*keys, *cols) for name, cols in subsets.items()}, keys)
        fits = [fit_of(model, name, name, k=k) for name in subsets]
        models = fit_all(train_points(points, key, dataset_col, fit_on), fits)
        stacked = label_all(points.where(F.col(dataset_col) == score_on), models, list(subsets), keys).withColumnRenamed("fit", "subset").drop(dataset_col)
    else:
        stacked = None
        for name, cols in subsets.items():
            one = MODELS[model].label(x.select(*keys, *cols), k).where(F.col(dataset_col) == score_on)
            one = one.select(F.lit(name).alias("subset"), key, "pred", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
            stacked = one if stacked is None else stacked.unionByName(one)
    scored = silhouette(write_table(stacked, "subsets"), "pred", "x", key, by=["subset"])
    return scored.select("subset", F.coalesce("silhouette_score", F.lit(WORST)).alias("score"))


def backward_feature_selection(x: DataFrame, model: str, k: int, features: Sequence[str], min_features: int = 3,
                               tol: float = 1e-3, key: str = "fund_cnpj", dataset_col: str = DATASET,
                               fit_on: str = "train", score_on: str = "test") -> DataFrame:
    """M13 as a table of steps (step, n_remaining, removed, test_silhouette, remaining). Step 0 has
    every feature. A later step takes the subset, one feature smaller, that scores best (the first in
    feature order on ties), as long as this gains ``tol`` and ``min_features`` stay."""
    x = write_table(x.select(key, dataset_col, *features), "selection")
    subset_of = lambda cols: {f: [c for c in cols if c != f] for f in cols}
    scored = lambda subsets: {r["subset"]: r["score"] for r in score_subsets(
        x, model, k, subsets, key, dataset_col, fit_on, score_on).collect()}   # a row per feature
    steps = [(0, len(features), None, scored({"all": list(features)}).get("all", WORST), list(features))]
    while steps[-1][1] > min_features:
        options = subset_of(steps[-1][4])
        scores = scored(options)
        ranked = sorted(options, key=lambda f: (-scores.get(f, WORST), steps[-1][4].index(f)))
        gain = scores.get(ranked[0], WORST) - steps[-1][3]
        if gain < tol:
            break
        kept = options[ranked[0]]
        steps.append((len(steps), len(kept), ranked[0], scores[ranked[0]], kept))
    return x.sparkSession.createDataFrame(
        steps, "step int, n_remaining int, removed string, test_silhouette double, remaining array<string>")
