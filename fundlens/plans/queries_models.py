"""Query registry, part 3: the build plan (X7), preprocessing (P*), clustering and evaluation (M*)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import cluster as M
from ..operators import evaluate as EV
from ..operators import preprocess as P
from ..operators.split import TRAIN
from . import sql_snippets as S
from .build import build_features, experiment_input
from .queries_prep import C1_CUT, C2_CUT, C6_CTES, fixture_clean_config
from .registry import register
from ..session import write_table
from .views import panel, read_table

LOOK = P.LOOK_FEATURES
_EPS10 = 10 * 2.220446049250313e-16

# ------------------------------------------------------------------ shared SQL: X7 fund table

_X7_CTES = (C6_CTES + ",\nspl AS (" + S.split_sql("c4", C1_CUT, C2_CUT) + "),"
            + S.daily_features_sql("spl", by="dataset") + ","
            + S.fund_aggregate_sql("d8", by="dataset")
            + f",\nft AS (SELECT * FROM g3 WHERE {S.null_fraction_sql()} <= 0.5),\n"
            + "ex AS (SELECT * FROM ft WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in S.ALL_32) + ")")


def _r(names):
    return ", ".join(f"round({n}, 6) AS {n}" if n != "max_time_drawdown" else n for n in names)


def fund_table(spark, sf_dir):
    return build_features(panel(spark, sf_dir), replace(fixture_clean_config(), write_rows=True), C2_CUT, C1_CUT)[1]


def exp_input(spark, sf_dir):
    """The experiment rows (a few per fund), materialised once: every fit and evaluation rereads them."""
    return write_table(experiment_input(fund_table(spark, sf_dir)), "experiment-input")


@register("x7_build_features", _X7_CTES + "\nSELECT dataset, fund_cnpj, " + _r(S.ALL_32) + " FROM ft")
def x7_build_features(spark, sf_dir):
    """Panel -> clean -> split -> per-(dataset, fund) features -> fund-level features."""
    return fund_table(spark, sf_dir)


@register("x7_daily_features", _X7_CTES + "\nSELECT dataset, fund_cnpj, report_date, round(\"return\", 6) AS \"return\", "
          "round(vol_5, 6) AS vol_5, round(vol_15, 6) AS vol_15, round(drawdown, 6) AS drawdown, time_in_drawdown FROM d8")
def x7_daily_features(spark, sf_dir):
    """X7 daily output: windows restart at each split (rows on the second cutoff appear twice)."""
    daily = build_features(panel(spark, sf_dir), replace(fixture_clean_config(), write_rows=True), C2_CUT, C1_CUT)[0]
    return daily.select("dataset", "fund_cnpj", "report_date", "return", "vol_5", "vol_15", "drawdown",
                        "time_in_drawdown")


# ------------------------------------------------------------------ P: preprocessing

@register("p1_just_filter", _X7_CTES + "\nSELECT fund_cnpj, dataset, " + _r(LOOK) + " FROM ex")
def p1_just_filter(spark, sf_dir):
    return P.just_filter(exp_input(spark, sf_dir))


def _robust_sql():
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_md, "
                   f"quantile_cont({c}, 0.75) AS {c}_q3" for c in LOOK)
    outs = ", ".join(f"round(({c} - {c}_md) / CASE WHEN {c}_q3 - {c}_q1 < {_EPS10!r} THEN 1.0 "
                     f"ELSE {c}_q3 - {c}_q1 END, 6) AS {c}" for c in LOOK)
    return (_X7_CTES + f",\nrq AS (SELECT {qs} FROM ex WHERE dataset = 'train')\n"
            f"SELECT fund_cnpj, dataset, {outs} FROM ex, rq")


@register("p2_robust_scale", _robust_sql())
def p2_robust_scale(spark, sf_dir):
    """Train-fitted median / IQR scaling applied to train, test and validation."""
    return P.robust_scale(exp_input(spark, sf_dir))


@register("p3_pca")
def p3_pca(spark, sf_dir):
    """Train-fitted principal axes (all components), applied to every split."""
    return P.pca(exp_input(spark, sf_dir))


@register("p3_pca_norms", _X7_CTES + ",\nmu AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in LOOK)
          + " FROM ex WHERE dataset = 'train')\nSELECT ex.fund_cnpj, ex.dataset, round("
          + " + ".join(f"(ex.{c} - mu.{c}) * (ex.{c} - mu.{c})" for c in LOOK) + ", 6) AS squared_norm FROM ex, mu")
def p3_pca_norms(spark, sf_dir):
    """All components together keep every row's squared distance from the train mean."""
    out = P.pca(exp_input(spark, sf_dir))
    axes = [c for c in out.columns if c.startswith("pca_")]
    return out.select("fund_cnpj", "dataset", sum((F.col(c) * F.col(c) for c in axes), F.lit(0.0)).alias("squared_norm"))


@register("p4_pca_scaling")
def p4_pca_scaling(spark, sf_dir):
    return P.pca_scaling(exp_input(spark, sf_dir))


@register("p5_pre_processing", _robust_sql())
def p5_pre_processing(spark, sf_dir):
    """P5: as in the reference, the fitted PCA is discarded, so the result equals P2."""
    return P.pre_processing(6, exp_input(spark, sf_dir))


@register("p6_check_matrix", _X7_CTES + "\nSELECT " + ", ".join(
    f"count_if({c} IS NULL OR isnan({c})) AS {c}_train_nulls" for c in LOOK) + " FROM ft WHERE dataset = 'train'")
def p6_check_matrix(spark, sf_dir):
    """Per look feature, NULL/NaN count in the train rows (the check raises if any is > 0)."""
    ft = fund_table(spark, sf_dir)
    P.check_matrix(experiment_input(ft))
    return ft.where(F.col("dataset") == TRAIN).agg(
        *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"{c}_train_nulls") for c in LOOK])


# ------------------------------------------------------------------ M: models

@register("m1_kmeans")
def m1_kmeans(spark, sf_dir):
    """M1: k-means (k=3) fitted on train fund features, labels for all splits."""
    x = P.just_filter(exp_input(spark, sf_dir))
    return M.fit_train_predict_all(x, M.kmeans(3))


_STEPS = 20  # Lloyd's steps of the query below and of its oracle; the clusters settle earlier


def _lloyd_ctes(k: int, steps: int) -> str:
    """Farthest-first start and ``steps`` steps of Lloyd's algorithm over tr(x, h) as a chain of CTEs."""
    dist = "list_distance(tr.x, c.x)"
    out = ["f0 AS MATERIALIZED (SELECT 0 AS label, x FROM tr ORDER BY h DESC LIMIT 1)"]
    for j in range(1, k):
        out.append(f"f{j} AS MATERIALIZED (SELECT * FROM f{j - 1} UNION ALL SELECT * FROM (SELECT {j} AS label, x FROM (SELECT tr.x, tr.h, "
                   f"min({dist}) AS d FROM tr, f{j - 1} c GROUP BY tr.x, tr.h) ORDER BY d DESC, h DESC LIMIT 1))")
    out.append(f"s0 AS MATERIALIZED (SELECT * FROM f{k - 1})")
    mean = ", ".join(f"avg(x[{i + 1}])" for i in range(len(LOOK)))
    for t in range(1, steps + 1):
        out.append(f"s{t} AS MATERIALIZED (SELECT c.label, coalesce(m.x, c.x) AS x FROM s{t - 1} c LEFT JOIN (SELECT label, [{mean}] AS x FROM "
                   f"(SELECT tr.x, arg_min(c.label, ({dist}, c.label)) AS label FROM tr, s{t - 1} c GROUP BY tr.x, tr.h) GROUP BY label) m USING (label))")
    return ",\n".join(out)


@register("m1_kmeans_labels", _X7_CTES + f""",
po AS (SELECT fund_cnpj, dataset, [{", ".join(f"CAST({c} AS DOUBLE)" for c in LOOK)}] AS x FROM ex),
tr AS MATERIALIZED (SELECT x, md5('0|' || fund_cnpj) AS h FROM po WHERE dataset = 'train'),
{_lloyd_ctes(3, _STEPS)}
SELECT fund_cnpj, dataset, CAST(arg_min(c.label, (list_distance(po.x, c.x), c.label)) AS INTEGER) AS pred
FROM po, s{_STEPS} c GROUP BY fund_cnpj, dataset, po.x""")
def m1_kmeans_labels(spark, sf_dir):
    """M1 + M3: seeded k-means (k = 3) of the batched fits on the train funds, labels for every split."""
    from ..operators.batched import Fit, fit_all, label_all

    keys = ("fund_cnpj", "dataset")
    points = M.stacked_points({"just_filter": P.just_filter(exp_input(spark, sf_dir))}, keys)
    fits = [Fit("k3", "just_filter", k=3, max_iter=_STEPS)]
    models = fit_all(M.train_points(points, "fund_cnpj", "dataset", TRAIN), fits)
    return label_all(points, models, ["k3"], keys).select(*keys, "pred")


@register("m2_gmm_starts")
def m2_gmm_starts(spark, sf_dir):
    """M2: mixtures of 2 to 5 components on scaled train funds, the best of three starts each, fitted at
    once; labels for every split."""
    from ..operators.batched import MIXTURE, Fit, fit_all, label_all

    keys = ("fund_cnpj", "dataset")
    points = M.stacked_points({"scalling": P.robust_scale(exp_input(spark, sf_dir))}, keys)
    fits = [Fit(f"k{k}", "scalling", MIXTURE, k, n_init=3) for k in (2, 3, 4, 5)]
    models = fit_all(M.train_points(points, "fund_cnpj", "dataset", TRAIN), fits)
    return label_all(points, models, [f.name for f in fits], keys).select(*keys, "fit", "pred")


@register("m2_gmm")
def m2_gmm(spark, sf_dir):
    """M2: Gaussian mixture (k=3) fitted on train fund features."""
    x = P.just_filter(exp_input(spark, sf_dir))
    return M.fit_train_predict_all(x, M.gmm(3))


@register("m3_fit_train_predict_all")
def m3_fit_train_predict_all(spark, sf_dir):
    """M3: robust-scaled inputs, k-means fitted on train, one transform labels every split."""
    return M.fit_train_predict_all(P.robust_scale(exp_input(spark, sf_dir)), M.kmeans(4))


def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


_EMB_CTE = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_CENT_SQL = f"""WITH {_EMB_CTE},
ex AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(len(x))) AS j FROM e),
c AS (SELECT label AS cl, list(m ORDER BY j) AS cx FROM (SELECT label, j, avg(v) AS m FROM ex GROUP BY label, j) GROUP BY label),
d AS (SELECT vec_id, cl, list_distance(x, cx) AS dist FROM e, c)
SELECT vec_id, CAST(arg_min(cl, dist) AS INTEGER) AS pred FROM d GROUP BY vec_id"""


@register("m3_assign_to_centroids", _CENT_SQL)
def m3_assign_to_centroids(spark, sf_dir):
    """M3 (deterministic part): each embedding to the nearest of the per-label mean vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    e = _emb(spark, sf_dir).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    cent = e.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("centre"))  # the model
    return M.assign_to_centroids(e, "x", cent).select("vec_id", F.col("pred").cast("int").alias("pred"))


def _sil_sql(src: str, feats: list[str], tag: str, by: str = "dataset") -> str:
    """CTEs computing the mean exact silhouette per ``by`` group of ``src`` (id fund_cnpj, label pred)."""
    dist = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in feats)
    return f"""pr{tag} AS (SELECT a.{by}, a.fund_cnpj, a.pred AS pa, b.pred AS pb, sqrt({dist}) AS dist
    FROM {src} a JOIN {src} b ON a.{by} = b.{by}),
pp{tag} AS (SELECT {by}, fund_cnpj, pa, pb, sum(dist) AS s, count(*) AS c FROM pr{tag} GROUP BY ALL),
ps{tag} AS (SELECT {by}, fund_cnpj, max(CASE WHEN pa = pb THEN s END) AS own_s, max(CASE WHEN pa = pb THEN c END) AS own_n,
    min(CASE WHEN pa <> pb THEN s / c END) AS bb FROM pp{tag} GROUP BY ALL),
ng{tag} AS (SELECT {by}, count(DISTINCT pred) AS g FROM {src} GROUP BY {by}),
sv{tag} AS (SELECT ps{tag}.{by}, avg(CASE WHEN g < 2 THEN NULL WHEN own_n <= 1 THEN 0.0
    ELSE (bb - own_s / (own_n - 1)) / greatest(own_s / (own_n - 1), bb) END) AS silhouette_score
    FROM ps{tag} JOIN ng{tag} USING ({by}) GROUP BY ps{tag}.{by})"""


def _bins_ctes(k: int) -> str:
    qs = ", ".join(f"quantile_cont(sharpe, {i}/{k}) AS q{i}" for i in range(1, k))
    pred = " + ".join(f"CASE WHEN sharpe > q{i} THEN 1 ELSE 0 END" for i in range(1, k))
    means = ", ".join(f"avg({c}) AS {c}" for c in LOOK)
    return f""",
b{k} AS (SELECT ex.*, {pred} AS pred FROM ex, (SELECT {qs} FROM ex WHERE dataset = 'train') qq),
m{k} AS (SELECT dataset, pred, {means}, count(*) AS cluster_size FROM b{k} GROUP BY dataset, pred),
{_sil_sql(f"b{k}", LOOK, str(k))},
r{k} AS (SELECT m{k}.*, sv{k}.silhouette_score, 'QuantileBins' AS model, {k} AS n_clusters,
    'just_filter' AS preprocessing FROM m{k} LEFT JOIN sv{k} USING (dataset))"""


_RESULT_COLS = ["dataset", "pred", *LOOK, "cluster_size", "silhouette_score", "model", "n_clusters", "preprocessing"]
_RES_SEL = ", ".join(f"round({c}, 6) AS {c}" if c in LOOK or c == "silhouette_score" else c for c in _RESULT_COLS)
_RESULTS_CTES = (_X7_CTES + "".join(_bins_ctes(k) for k in (2, 3, 4, 5))
                 + ",\nres AS (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in (2, 3, 4, 5)) + ")")


def bins_results(spark, sf_dir, ks=(2, 3, 4, 5)):
    """M4 results for the deterministic QuantileBins clusterer (k = 2..5) on the fund features.

    All cut points come from one exact-quantile search, and every k is evaluated in one pass:
    the labelings are stacked with ``n_clusters`` as an extra group key of the means and of the
    silhouette."""
    from ..operators.quantiles import exact_quantiles

    ex = exp_input(spark, sf_dir)
    probs = sorted({i / k for k in ks for i in range(1, k)})
    q = exact_quantiles(ex.where(F.col("dataset") == TRAIN), ["sharpe"], probs, materialize=False)
    stacked = None
    for k in ks:
        label = F.lit(0)
        for i in range(1, k):
            label = label + (F.col("sharpe") > F.lit(q[("sharpe", i / k)])).cast("int")
        one = ex.select("fund_cnpj", "dataset", *LOOK, F.lit(k).alias("n_clusters"), label.alias("pred"))
        stacked = one if stacked is None else stacked.unionByName(one)
    keys = ["n_clusters", "dataset"]
    stacked = write_table(stacked, "bins")
    out = (EV.evaluate_clusters(stacked, stacked, LOOK, "fund_cnpj", by=keys, labelings=["n_clusters"]).withColumn("model", F.lit("QuantileBins"))
           .withColumn("preprocessing", F.lit("just_filter")))
    # a few rows per configuration, read by several later steps: materialise once
    return write_table(out.select(*_RESULT_COLS), "experiment-results")


@register("m4_evaluate_clusters", _X7_CTES + _bins_ctes(3) + "\nSELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c in LOOK or c == "silhouette_score" else c for c in _RESULT_COLS) + " FROM r3")
def m4_evaluate_clusters(spark, sf_dir):
    """M4: per (dataset, cluster) raw-feature means, cluster size, and the dataset's exact silhouette."""
    return bins_results(spark, sf_dir, ks=(3,))


_SIL_EMB = f"""WITH {_EMB_CTE},
pr AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.x, b.x) AS dist FROM e a, e b),
pp AS (SELECT vec_id, la, lb, sum(dist) AS s, count(*) AS c FROM pr GROUP BY ALL),
ps AS (SELECT vec_id, max(CASE WHEN la = lb THEN s END) AS own_s, max(CASE WHEN la = lb THEN c END) AS own_n,
    min(CASE WHEN la <> lb THEN s / c END) AS bb FROM pp GROUP BY vec_id)
SELECT round(avg(CASE WHEN own_n <= 1 THEN 0.0 ELSE (bb - own_s / (own_n - 1)) / greatest(own_s / (own_n - 1), bb) END), 6)
  AS silhouette_score FROM ps"""


@register("m5_silhouette", _SIL_EMB)
def m5_silhouette(spark, sf_dir):
    """M5: exact Euclidean silhouette of the embeddings under their labels (block pairs, no pair rows)."""
    return EV.silhouette(_emb(spark, sf_dir), "label", "embedding", "vec_id")


_CH_EMB = f"""WITH {_EMB_CTE},
ex AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(len(x))) AS j FROM e),
ck AS (SELECT label, j, avg(v) AS ck, count(*) AS nk FROM ex GROUP BY label, j),
cg AS (SELECT j, avg(v) AS c FROM ex GROUP BY j),
w AS (SELECT sum((v - ck) * (v - ck)) AS w FROM ex JOIN ck USING (label, j)),
b AS (SELECT sum(nk * (ck - c) * (ck - c)) AS b FROM ck JOIN cg USING (j)),
n AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM e)
SELECT round(CASE WHEN k < 2 OR n <= k THEN NULL WHEN w = 0 THEN 1.0 ELSE (b / (k - 1)) / (w / (n - k)) END, 6)
  AS calinski_harabasz FROM w, b, n"""


@register("m6_calinski_harabasz", _CH_EMB)
def m6_calinski_harabasz(spark, sf_dir):
    return EV.calinski_harabasz(_emb(spark, sf_dir), "label", "embedding")


@register("m7_param_search")
def m7_param_search(spark, sf_dir):
    """M7: k-means over k = 2..5 on the train fund features; best exact silhouette (first wins)."""
    x = P.just_filter(exp_input(spark, sf_dir).where(F.col("dataset") == TRAIN), keep=("fund_cnpj",))
    params, score, _ = M.param_search(x, "KMeansTrainer", [{"n_clusters": k} for k in (2, 3, 4, 5)])
    return spark.createDataFrame([(int(params["n_clusters"]) if params else None, score)],
                                 "n_clusters int, silhouette_score double")


_METRICS = ["quota_value", "total_value", "net_asset_value"]


def _w1_sql(u: str, v: str, tag: str) -> str:
    """CTEs giving w1{tag}(feature, w) between value sets ``u`` and ``v`` (feature, value)."""
    return f"""pool{tag} AS (SELECT feature, value AS v, sum(cu) AS cu, sum(cv) AS cv FROM (
    SELECT feature, value, 1 AS cu, 0 AS cv FROM {u} UNION ALL SELECT feature, value, 0 AS cu, 1 AS cv FROM {v})
    WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature, value),
tot{tag} AS (SELECT feature, sum(cu) AS nu, sum(cv) AS nv FROM pool{tag} GROUP BY feature),
cum{tag} AS (SELECT feature, v, sum(cu) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nu AS fu,
    sum(cv) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nv AS fv,
    lead(v) OVER (PARTITION BY feature ORDER BY v) AS nx FROM pool{tag} JOIN tot{tag} USING (feature)),
w1{tag} AS (SELECT feature, sum(CASE WHEN nx IS NULL THEN 0.0 ELSE abs(fu - fv) * (nx - v) END) AS w FROM cum{tag} GROUP BY feature)"""


_M8_SQL = (f"WITH {S.PANEL_CTE},\nlv AS (" + " UNION ALL ".join(
    f"SELECT report_date, '{m}' AS feature, {m} AS value FROM panel" for m in _METRICS) + "),\n"
    + f"uu AS (SELECT feature, value FROM lv WHERE report_date <= DATE '{C1_CUT}'),\n"
    + f"vv AS (SELECT feature, value FROM lv WHERE report_date >= DATE '{C2_CUT}'),\n"
    + _w1_sql("uu", "vv", "") + "\nSELECT feature, round(w, 6) AS wasserstein FROM w1")


@register("m8_wasserstein_1d", _M8_SQL)
def m8_wasserstein_1d(spark, sf_dir):
    """M8: exact W1 between the train-period and validation-period distributions of three metrics."""
    p = panel(spark, sf_dir)
    long = p.select("report_date", F.explode(F.array(*[
        F.struct(F.lit(m).alias("feature"), F.col(m).alias("value")) for m in _METRICS])).alias("_m")
    ).select("report_date", "_m.*")
    u = long.where(F.col("report_date") <= F.lit(C1_CUT).cast("date"))
    v = long.where(F.col("report_date") >= F.lit(C2_CUT).cast("date"))
    return EV.wasserstein_1d(u, v, "value", by=["feature"])


_M8_FUND_SQL = (f"WITH {S.PANEL_CTE},\nuu AS (SELECT fund_cnpj AS feature, quota_value AS value FROM panel WHERE report_date <= DATE '{C1_CUT}'),\n"
                f"vv AS (SELECT fund_cnpj AS feature, quota_value AS value FROM panel WHERE report_date >= DATE '{C2_CUT}'),\n"
                + _w1_sql("uu", "vv", "") + "\nSELECT feature AS fund_cnpj, round(w, 6) AS wasserstein FROM w1 JOIN tot USING (feature) WHERE nu > 0 AND nv > 0")


@register("m8_wasserstein_by_fund", _M8_FUND_SQL)
def m8_wasserstein_by_fund(spark, sf_dir):
    """M8: W1 between every fund's quotas of the train period and of the validation period."""
    p = panel(spark, sf_dir).select("fund_cnpj", "report_date", "quota_value")
    u = p.where(F.col("report_date") <= F.lit(C1_CUT).cast("date"))
    v = p.where(F.col("report_date") >= F.lit(C2_CUT).cast("date"))
    return EV.wasserstein_1d(u, v, "quota_value", by=["fund_cnpj"]).where("wasserstein IS NOT NULL")


@register("m9_run_all_experiments")
def m9_run_all_experiments(spark, sf_dir):
    """M9: the reference grid (2 models x k 2..5 x 4 preprocessings) evaluated on 3 splits."""
    return M.run_all_experiments(exp_input(spark, sf_dir))


@register("m10_best_by_silhouette", _RESULTS_CTES + "\nSELECT " + _RES_SEL + " FROM res WHERE dataset = 'validation' "
          "AND silhouette_score = (SELECT max(silhouette_score) FROM res WHERE dataset = 'validation')")
def m10_best_by_silhouette(spark, sf_dir):
    return EV.best_by_silhouette(bins_results(spark, sf_dir))


_BEST_CFG = ("(SELECT model, n_clusters, preprocessing FROM res WHERE dataset = 'validation' "
             "ORDER BY silhouette_score DESC NULLS LAST, model, n_clusters, preprocessing LIMIT 1)")


@register("m11_select_config", _RESULTS_CTES + "\nSELECT " + _RES_SEL + " FROM res WHERE (model, n_clusters, preprocessing) IN "
          + _BEST_CFG)
def m11_select_config(spark, sf_dir):
    return EV.select_config(bins_results(spark, sf_dir))


_STAB = [*LOOK, "cluster_size"]
_M12_SQL = (_RESULTS_CTES + ",\nbest AS (SELECT * FROM res WHERE (model, n_clusters, preprocessing) IN " + _BEST_CFG + "),\n"
            + "lv AS (" + " UNION ALL ".join(f"SELECT dataset, '{m}' AS feature, CAST({m} AS DOUBLE) AS value FROM best"
                                              for m in _STAB) + "),\n"
            + "tr AS (SELECT feature, value FROM lv WHERE dataset = 'train'),\n"
            + "te AS (SELECT feature, value FROM lv WHERE dataset = 'test'),\n"
            + "va AS (SELECT feature, value FROM lv WHERE dataset = 'validation'),\n"
            + _w1_sql("tr", "te", "a") + ",\n" + _w1_sql("tr", "va", "b")
            + "\nSELECT feature, round(w1a.w, 6) AS train_vs_test_dist, round(w1b.w, 6) AS train_vs_val_dist "
              "FROM w1a FULL OUTER JOIN w1b USING (feature)")


@register("m12_stability_report", _M12_SQL)
def m12_stability_report(spark, sf_dir):
    """W1(train, test) and W1(train, validation) of 7 metrics for the selected configuration."""
    return EV.stability_report(EV.select_config(bins_results(spark, sf_dir)), _STAB)


@register("x8_run_and_report", _M12_SQL.replace(
    "\nSELECT feature, ", "\nSELECT feature, (SELECT any_value(model) FROM best) AS model, (SELECT any_value(n_clusters) FROM best) "
    "AS n_clusters, (SELECT any_value(preprocessing) FROM best) AS preprocessing, (SELECT count(*) FROM res WHERE dataset = "
    "'validation' AND silhouette_score = (SELECT max(silhouette_score) FROM res WHERE dataset = 'validation')) AS n_best, "))
def x8_run_and_report(spark, sf_dir):
    """The grid of the deterministic model, from the fund table to the stability report."""
    from .report import run_and_report

    return run_and_report(fund_table(spark, sf_dir), models=("QuantileBins",), preprocessing=("just_filter",))


@register("x8_full_grid_report")
def x8_full_grid_report(spark, sf_dir):
    """X8 with its defaults: both models, k = 2 to 5 and all four preprocessings (32 configurations),
    from the fund table over fits, evaluation and result CSV to the selected one's stability."""
    from .report import run_and_report

    return run_and_report(fund_table(spark, sf_dir))


@register("m13_backward_feature_selection")
def m13_backward_feature_selection(spark, sf_dir):
    """Greedy backward elimination (k-means k=3, fit on train, silhouette on test)."""
    x = P.just_filter(exp_input(spark, sf_dir))
    steps = M.backward_feature_selection(x, "KMeansTrainer", 3, LOOK)
    return steps.select("step", "n_remaining", "removed", "test_silhouette")
