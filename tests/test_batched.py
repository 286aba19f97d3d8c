"""Clusterings fitted at once, against NumPy."""

import hashlib

import numpy as np
import pytest

from fundlens.operators import batched as B
from fundlens.operators import cluster as C


def make(spark, spaces):
    rows = [(s, f"p{i:04d}", [float(v) for v in x]) for s, points in spaces.items() for i, x in enumerate(points)]
    return spark.createDataFrame(rows, "space string, key string, x array<double>")


def start(points, k, seed=0):
    tie = [hashlib.md5(f"{seed}|p{i:04d}".encode()).hexdigest() for i in range(len(points))]
    chosen = [points[max(range(len(points)), key=lambda i: tie[i])]]
    while len(chosen) < k:
        d = np.min([((points - c) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(points[max(range(len(points)), key=lambda i: (d[i], tie[i]))])
    return np.array(chosen)


def lloyd(points, k, seed=0, steps=300):
    c = start(points, k, seed)
    for _ in range(steps):
        label = ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([points[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c, rtol=1e-9, atol=1e-9):
            return new
        c = new
    return c


def mixture(points, k, seed=0, reg=1e-6, tol=1e-3, steps=100):
    c = lloyd(points, k, seed)
    r = np.eye(k)[((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)]
    last = -np.inf
    for step in range(steps + 1):
        n = r.sum(axis=0) + 10 * np.finfo(float).eps
        mu = r.T @ points / n[:, None]
        cov = np.array([(r[:, j, None] * (points - mu[j])).T @ (points - mu[j]) / n[j] + reg * np.eye(points.shape[1]) for j in range(k)])
        s = np.column_stack([np.log(n[j] / n.sum()) - 0.5 * (np.einsum("ni,ij,nj->n", points - mu[j], np.linalg.inv(cov[j]), points - mu[j])
                             + np.linalg.slogdet(cov[j])[1] + points.shape[1] * np.log(2 * np.pi)) for j in range(k)])
        norm = np.logaddexp.reduce(s, axis=1)
        r, ll = np.exp(s - norm[:, None]), norm.mean()
        if abs(ll - last) < tol:
            break
        last = ll
    return mu, cov, n / n.sum(), ll


@pytest.fixture(scope="module")
def spaces():
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(m, 1, (60, 3)) for m in (0, 4, 9)])
    return {"a": a, "b": rng.normal(0, 3, (90, 2)) * [1, 5]}


def test_all_k_means_fits_match_numpy(spark, spaces):
    points = make(spark, spaces).repartition(5).cache()
    fits = [B.Fit(f"{s}{k}{seed}", s, B.KMEANS, k, seed) for s in spaces for k in (1, 2, 3, 5) for seed in (0, 7)]
    models = B.fit_all(points, fits)
    for f, m in zip(fits, models):
        assert m.fit == f and np.allclose(m.centres, lloyd(spaces[f.space], f.k, f.seed), atol=1e-8)
    labeled = B.label_all(points, models, [f.name for f in fits], ["key"]).collect()
    assert len(labeled) == sum(len(x) for x in spaces.values()) * 8
    m = models[3]
    for r in labeled:
        if r.fit == m.fit.name:
            assert r.pred == ((np.array(r.x) - m.centres) ** 2).sum(axis=1).argmin()


def test_mixtures_match_numpy_and_the_best_start_stays(spark, spaces):
    points = make(spark, spaces).repartition(4).cache()
    fits = [B.Fit(f"{s}{k}", s, B.MIXTURE, k) for s in spaces for k in (1, 2, 3)] + [B.Fit("many", "b", B.MIXTURE, 3, n_init=4, tol=1e-5)]
    models = B.fit_all(points, fits)
    for f, m in zip(fits[:-1], models):
        mu, cov, w, ll = mixture(spaces[f.space], f.k)
        assert np.allclose(m.centres, mu, atol=1e-6) and np.allclose(m.covariances, cov, atol=1e-6)
        assert np.allclose(m.weights, w, atol=1e-6) and abs(m.likelihood - ll) < 1e-6
    best = max(mixture(spaces["b"], 3, s, tol=1e-5)[3] for s in range(4))
    assert abs(models[-1].likelihood - best) < 1e-6


def test_duplicates_few_points_and_no_points(spark):
    points = make(spark, {"a": np.array([[1.0, 2.0]] * 4)})
    (m,) = B.fit_all(points, [B.Fit("x", "a", B.KMEANS, 3)])
    assert m.centres.tolist() == [[1.0, 2.0]] * 3
    (m,) = B.fit_all(points, [B.Fit("x", "a", B.MIXTURE, 2)])
    assert np.isfinite(m.likelihood) and np.allclose(m.centres[0], [1, 2])
    with pytest.raises(ValueError):
        B.fit_all(points.limit(0), [B.Fit("x", "a")])


def test_search_takes_the_first_best_and_model_parameters(spark, spaces):
    x = spark.createDataFrame([(f"p{i:04d}", *map(float, v)) for i, v in enumerate(spaces["a"])], "fund_cnpj string, u double, v double, w double")
    params, score, labels = C.param_search(x, "KMeansTrainer", [{"n_clusters": 2}, {"n_clusters": 3}, {"n_clusters": 3, "random_state": 0}, {"k": 4}])
    assert params == {"n_clusters": 3} and 0.5 < score < 1 and labels.select("pred").distinct().count() == 3
    assert C.param_search(x, "KMeansTrainer", [{"n_clusters": 1}])[0] is None
    rows = [(f, d, *map(float, v)) for d in ("train", "test", "validation") for f, v in zip((f"p{i}" for i in range(180)), spaces["a"])]
    ex = spark.createDataFrame(rows, "fund_cnpj string, dataset string, u double, v double, w double")
    out = C.run_all_experiments(ex, models=("KMeansTrainer", ("GMMTrainer", {"n_init": 2, "reg_covar": 1e-3})), clusters=(2, 3),
                                preprocessing=("just_filter", "scalling"), look_features=["u", "v", "w"]).collect()
    assert {(r.model, r.n_clusters, r.preprocessing, r.dataset) for r in out} == {
        (m, k, p, d) for m in ("KMeansTrainer", "GMMTrainer") for k in (2, 3) for p in ("just_filter", "scalling") for d in ("train", "test", "validation")}
    assert all(r.silhouette_score > 0.3 for r in out)
