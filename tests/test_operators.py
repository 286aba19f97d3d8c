"""Edge fixtures (FIXTURES.md §3), brute-force cross-checks and plan-shape tests."""

import datetime as dt
import io
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

D0 = dt.date(2024, 1, 1)


def series(spark, values, col="quota_value", fund="00000000000001"):
    rows = [(fund, D0 + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"fund_cnpj string, report_date date, {col} double")


def ordered(df, col):
    return [r[col] for r in df.orderBy("report_date").collect()]


def close(a, b, tol=1e-6):
    if a is None or b is None:
        return a is None and b is None
    if math.isinf(a) or math.isinf(b):
        return a == b
    return abs(a - b) <= tol


def test_e1_return_ffill_and_inf(spark):
    from fundlens.operators.features import add_return

    out = ordered(add_return(series(spark, [1, None, 2, 0, 3])), "return")
    assert [close(a, b) for a, b in zip(out, [None, 0.0, 1.0, -1.0, math.inf])] == [True] * 5


def test_e2_drawdown(spark):
    from fundlens.operators.features import add_drawdown

    out = ordered(add_drawdown(series(spark, [10, 0, None, 5])), "drawdown")
    assert [close(a, b) for a, b in zip(out, [0.0, None, None, 1.0])] == [True] * 4


def test_e3_rolling_std_skips_inf(spark):
    from fundlens.operators.features import add_rolling_vol

    df = series(spark, [0.1, math.inf, 0.2, 0.3, None, 0.5], col="return")
    out = ordered(add_rolling_vol(df, windows=[3]), "vol_3")
    exp = [None, None, 0.0707107, 0.0707107, 0.0707107, 0.1414214]
    assert [close(a, b) for a, b in zip(out, exp)] == [True] * 6


def test_e4_time_in_drawdown(spark):
    from fundlens.operators.features import add_time_in_drawdown

    flags = [0, 0, 1, 1, 0, 1, 1, 1, 0]
    out = ordered(add_time_in_drawdown(series(spark, [float(x) for x in flags], col="drawdown")), "time_in_drawdown")
    assert out == [0, 0, 1, 2, 0, 1, 2, 3, 0]


def _moments(spark, values):
    from fundlens.functions.columns import adjusted_kurt, adjusted_skew, stddev_samp

    df = series(spark, values, col="r")
    return df.agg(stddev_samp("r").alias("s"), adjusted_skew("r").alias("g1"), adjusted_kurt("r").alias("g2")).first()


def test_e5_e6_e7_moments(spark):
    r = _moments(spark, [0.2] * 6)
    assert (r["s"], r["g1"], r["g2"]) == (0.0, 0.0, 0.0)
    r = _moments(spark, [1, 2, 3, 10, 4.5])
    assert close(r["g1"], 1.546910) and close(r["g2"], 2.515912)
    assert _moments(spark, [1, 2])["g1"] is None
    assert _moments(spark, [1, 2, 3])["g2"] is None


def test_e8_safe_divide(spark):
    from fundlens.functions.columns import safe_divide

    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_divide("a", "b")).collect()] == [None, 0.5, None]


def test_e14_single_row_fund(spark):
    from fundlens.operators.clean import filter_max_gap
    from fundlens.functions.columns import stddev_samp

    df = series(spark, [1.0])
    assert filter_max_gap(df, 6).count() == 1
    assert df.agg(stddev_samp("quota_value")).first()[0] is None


def test_e13_id_standardisation(spark):
    from fundlens.operators.normalize import standardize_id

    df = spark.createDataFrame([(None,), ("00.017.024/0001-53",), ("123",)], "CNPJ_FUNDO string")
    assert [r[0] for r in standardize_id(df).collect()] == ["", "00017024000153", "123"]


def test_e16_snake_case():
    from fundlens.functions.columns import snake_case

    assert [snake_case(x) for x in ["  DT.COMPTC ", "Valor  Quota", "AÇÃO"]] == ["dt_comptc", "valor_quota", "ao"]


def test_e12_keep_max_ties_and_all_null(spark):
    from fundlens.operators.dedupe import dedupe_keep_max

    rows = [("f", D0, 5, 1.0), ("f", D0, 5, 2.0), ("g", D0, None, 1.0), ("g", D0, None, 3.0), (None, D0, 9, 1.0)]
    df = spark.createDataFrame(rows, "fund_cnpj string, report_date date, num_shareholders long, quota_value double")
    out = {r["fund_cnpj"]: r["quota_value"] for r in dedupe_keep_max(df).collect()}
    assert out == {"f": 2.0, "g": 3.0}


def test_e15_wasserstein(spark):
    from fundlens.operators.evaluate import wasserstein_1d

    u = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "x double")
    v = spark.createDataFrame([(1.5,), (2.5,), (2.5,), (9.0,)], "x double")
    assert close(wasserstein_1d(u, v, "x", partitions=3).first()["wasserstein"], 1.625)


def _w1_ref(a, b):
    xs = np.sort(np.concatenate([a, b]))
    ua, ub = np.sort(a), np.sort(b)
    fa = np.searchsorted(ua, xs[:-1], "right") / len(a)
    fb = np.searchsorted(ub, xs[:-1], "right") / len(b)
    return float(np.sum(np.abs(fa - fb) * np.diff(xs)))


def test_wasserstein_many_partitions_matches_reference(spark):
    from fundlens.operators.evaluate import wasserstein_1d

    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 400).round(2), rng.normal(0.3, 2, 300).round(2)
    rows = [("m1", float(x), "u") for x in a] + [("m1", float(x), "v") for x in b]
    rows += [("m2", float(x) * 3, "u") for x in b] + [("m2", float(x), "v") for x in a]
    df = spark.createDataFrame(rows, "metric string, x double, side string")
    out = {r["metric"]: r["wasserstein"] for r in wasserstein_1d(
        df.where("side = 'u'"), df.where("side = 'v'"), "x", by=["metric"], partitions=7).collect()}
    assert close(out["m1"], _w1_ref(a, b), 1e-9) and close(out["m2"], _w1_ref(b * 3, a), 1e-9)


def test_exact_quantiles_match_numpy(spark):
    from fundlens.operators import quantiles as Q

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_cauchy(30000), np.full(500, 2.5)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    old = Q.FETCH_LIMIT
    Q.FETCH_LIMIT = 50  # force several narrowing rounds
    try:
        probs = [0.00001, 0.25, 0.5, 0.75, 0.99999]
        got = Q.exact_quantiles(df, ["x"], probs)
    finally:
        Q.FETCH_LIMIT = old
    for p in probs:
        assert close(got[("x", p)], float(np.quantile(x, p)), 1e-9)


def _silhouette_ref(x, labels):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == lab].mean() for lab in set(labels) if lab != labels[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_blocks_match_brute_force(spark):
    from fundlens.operators.evaluate import silhouette

    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(4, 1, (25, 3)), rng.normal([0, 5, 0], 1, (1, 3))])
    labels = np.array([0] * 40 + [1] * 25 + [2])
    rows = [(i, int(labels[i]), *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, lab int, a double, b double, c double")
    got = silhouette(df, "lab", ["a", "b", "c"], "id", block_rows=16).first()["silhouette_score"]
    assert close(got, _silhouette_ref(x, labels), 1e-9)


def test_e9_bad_lines_and_e10_latin1(spark, tmp_path):
    from fundlens.sources.files import columns_from_fields, scan_csv_tree

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.CSV").write_bytes(b"ID;NM;V\n1;a;1\n2;b\n3;c;3;9\n4;d;4\n")
    (tmp_path / "b.csv").write_bytes("ID;NM\n5;S\xe3o\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("ID;NM\n6;São\n".encode("utf-8"))
    rows, headers = scan_csv_tree(spark, str(tmp_path))
    got = {r["ID"]: (r["NM"], r["V"]) for r in columns_from_fields(rows, headers).collect()}
    assert got == {"1": ("a", "1"), "2": ("b", None), "4": ("d", "4"), "5": ("São", None), "6": ("São", None)}


def test_zip_monthly_reader(spark, tmp_path):
    from fundlens.sources.files import read_monthly_quotas

    def mk(name, member, text):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr(member, text)
        (tmp_path / name).write_bytes(buf.getvalue())

    mk("inf_202401.zip", "inf_202401.csv", "TP;CNPJ_FUNDO_CLASSE;DT_COMPTC;VL_QUOTA\nFI;1;2024-01-02;1.5\n")
    mk("inf_202402.zip", "other.csv", "CNPJ_FUNDO;DT_COMPTC;VL_QUOTA\n2;2024-02-01;2\n")
    (tmp_path / "inf_202403.zip").write_bytes(b"not a zip")
    out = [tuple(r) for r in read_monthly_quotas(spark, str(tmp_path)).select("CNPJ_FUNDO", "DT_COMPTC", "VL_QUOTA").collect()]
    assert out == [("1", "2024-01-02", "1.5")]


def test_split_reference_boundary(spark):
    from fundlens.operators.split import split_labeled

    df = spark.createDataFrame([("f", dt.date(2000, 12, 31)), ("f", dt.date(1998, 12, 31))],
                               "fund_cnpj string, report_date date")
    got = sorted(tuple(r) for r in split_labeled(df, "2000-12-31", "1998-12-31").select("report_date", "dataset").collect())
    assert got == [(dt.date(1998, 12, 31), "train"), (dt.date(2000, 12, 31), "test"), (dt.date(2000, 12, 31), "validation")]
    dis = split_labeled(df, "2000-12-31", "1998-12-31", boundary="disjoint").where("dataset = 'validation'").count()
    assert dis == 0


def test_split_random_exact_size(spark):
    from fundlens.operators.split import split_random
    from fundlens.plans.views import panel

    p = panel(spark, SF)
    out = split_random(p, "2000-12-31", 0.2, 42, key_cols=["fund_cnpj", "report_date"])
    n_pre = p.where(F.col("report_date") < F.lit("2000-12-31").cast("date")).count()
    assert out.where("dataset = 'test'").count() == math.ceil(0.2 * n_pre)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_features_and_aggregate_single_fund_exchange(spark):
    """F7 + A8 over the panel: the panel groupBy's exchanges plus exactly one on fund_cnpj."""
    from fundlens.operators.aggregate import aggregate_features
    from fundlens.operators.features import create_features
    from fundlens.plans.views import panel

    p = panel(spark, SF)
    base = _exchanges(p)
    out = aggregate_features(create_features(p, dedupe=False))
    assert _exchanges(out) == base + 1


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert set(df.columns) == {"fund_cnpj", "mean_return", "std_return", "sharpe"}
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 95


@pytest.mark.parametrize("name", ["a8_aggregate_features", "c6_clean", "k1_dedupe_keep_max", "m8_wasserstein_1d"])
def test_query_matches_oracle_smoke(spark, name):
    import duckdb

    import __spark_entry__ as E
    from fundlens.plans.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    key = lambda row: repr(row)

    def norm(cs, rows):
        order = sorted(range(len(cs)), key=lambda i: cs[i])
        return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows], key=key)

    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm(cols, cur.fetchall())


def test_streaming_increments_upsert(spark, tmp_path):
    from fundlens.sources.month_table import read_table
    from fundlens.streaming.increments import ingest_new_files

    land, table = tmp_path / "landing", str(tmp_path / "table")
    land.mkdir()
    (land / "m1.csv").write_text("CNPJ_FUNDO;DT_COMPTC;VL_QUOTA\n00.000.000/0001-01;2024-01-02;1.0\n"
                                 "00.000.000/0001-01;2024-02-01;2.0\n")
    ingest_new_files(spark, str(land), table)
    (land / "m2.csv").write_text("TP_FUNDO;CNPJ_FUNDO_CLASSE;VL_QUOTA;DT_COMPTC\nFI;00.000.000/0001-01;2.5;2024-02-01\n"
                                 "FI;00.000.000/0001-01;3.0;2024-03-01\n")
    ingest_new_files(spark, str(land), table)
    got = sorted((str(r["report_date"]), r["quota_value"]) for r in read_table(spark, table).collect())
    assert got == [("2024-01-02", 1.0), ("2024-02-01", 2.5), ("2024-03-01", 3.0)]


def test_build_features_plan_one_exchange_after_cleaning(spark):
    """One exchange on fund_cnpj serves the C4 flag window, every per-(dataset, fund) feature
    window and the fund aggregation; the others are the panel's own."""
    from fundlens.plans.build import build_features
    from fundlens.plans.queries_prep import C1_CUT, C2_CUT, fixture_clean_config
    from fundlens.plans.views import panel

    p = panel(spark, SF)
    _, fund = build_features(p, fixture_clean_config(), C2_CUT, C1_CUT)
    assert _exchanges(fund) == _exchanges(p) + 1


def test_keep_max_is_partially_aggregated(spark):
    """K1 reduces every key map-side (partial aggregate before the exchange): hot keys stay cheap."""
    from fundlens.operators.dedupe import dedupe_keep_max
    from fundlens.plans.views import raw_reports

    plan = dedupe_keep_max(raw_reports(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(struct(" in plan and "row_number" not in plan


def test_load_raw_drops_empty_columns_from_metadata_pass(spark, tmp_path):
    from fundlens.plans.load import load_panel, load_raw

    (tmp_path / "m1.csv").write_text("CNPJ_FUNDO;DT_COMPTC;VL_QUOTA;NR_COTST;OBS\n"
                                     "00.000.000/0001-01;2024-01-02;1.5;10;\n00.000.000/0001-01;2024-01-02;1.6;12;\n")
    (tmp_path / "m2.csv").write_text("CNPJ_FUNDO_CLASSE;DT_COMPTC;VL_QUOTA;NR_COTST\n00.000.000/0001-01;2024-02-01;2.0;\n")
    raw = load_raw(spark, str(tmp_path))
    assert "obs" not in raw.columns and raw.columns[:2] == ["fund_cnpj", "report_date"]
    got = sorted((str(r["report_date"]), r["quota_value"], r["num_shareholders"])
                 for r in load_panel(spark, str(tmp_path)).collect())
    assert got == [("2024-01-02", 1.6, 12), ("2024-02-01", 2.0, None)]


def _sil(spark, x, labels, **kw):
    from fundlens.operators.evaluate import silhouette

    rows = [(i, int(lab), [float(v) for v in p]) for i, (p, lab) in enumerate(zip(x, labels))]
    return silhouette(spark.createDataFrame(rows, "id long, lab int, x array<double>"), "lab", "x", "id", **kw).first()[0]


def test_silhouette_coincident_offset_and_mixed_scales(spark):
    rng = np.random.default_rng(5)
    same = np.zeros((6, 2))
    assert _sil(spark, same, [0, 0, 0, 1, 1, 1]) == 0.0
    labels = np.array([0] * 20 + [1] * 25 + [2] * 3)
    base = rng.normal(0, 1e-3, (48, 3)) + labels[:, None] * 1e-3
    for x in (base + 1e6, base * np.array([1.0, 1e7, 1e-5]), base):
        assert close(_sil(spark, x, labels, block_rows=11), _silhouette_ref(x, labels), 1e-9)


def test_evaluate_clusters_on_stacked_labelings(spark):
    from fundlens.operators.evaluate import evaluate_clusters

    rows = [(f"f{i}", d, k, i % k, float(i), float(i * i)) for d in ("train", "test") for k in (2, 3) for i in range(9)]
    df = spark.createDataFrame(rows, "fund_cnpj string, dataset string, k int, pred int, a double, b double")
    out = {(r.dataset, r.k, r.pred): r for r in evaluate_clusters(df, df, ["a", "b"], by=["k", "dataset"]).collect()}
    assert len(out) == 10 and out[("train", 2, 0)].cluster_size == 5 and out[("test", 3, 1)].a == 4.0
    x = np.array([[i, i * i] for i in range(9)], float)
    assert close(out[("test", 3, 1)].silhouette_score, _silhouette_ref(x, np.arange(9) % 3), 1e-9)


def test_quantile_rounds_reach_any_spread(spark):
    from fundlens.operators import quantiles as Q

    x = np.concatenate([[1e280, -1e300, 5e-324, -5e-324, 0.0], np.random.default_rng(2).normal(0, 1e-9, 3000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    old, Q.FETCH_LIMIT = Q.FETCH_LIMIT, 1
    try:
        assert Q.kth_smallest(df, "x", 1500) == np.sort(x)[1500]
        assert Q.kth_smallest(df, "x", len(x) - 1) == 1e280
    finally:
        Q.FETCH_LIMIT = old


def test_random_split_is_exact_on_repeated_rows(spark):
    from fundlens.operators.split import split_random

    rows = [("f", D0, 1.0)] * 10 + [("g", D0, float(i)) for i in range(7)] + [("f", D0, 2.0)] * 5
    df = spark.createDataFrame(rows, "fund_cnpj string, report_date date, v double")
    for ratio in (0.0, 0.2, 0.5, 0.9):
        got = {n: sorted(map(tuple, split_random(df.repartition(n), "2030-01-01", ratio, key_cols=["fund_cnpj"]).collect())) for n in (2, 16)}
        assert got[2] == got[16] and len(got[2]) == 22
        assert sum(r[-1] == "test" for r in got[2]) == math.ceil(ratio * 22)


def test_csv_quotes_missing_tokens_dates_and_width(spark, tmp_path):
    from fundlens.plans.load import load_raw
    from fundlens.sources.files import columns_from_fields, scan_csv_tree

    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.csv").write_text('CNPJ_FUNDO;NM;DT_COMPTC;NR_COTST;VL_QUOTA\n1;"A; ""B""";31/12/2024;NaN;NaN\n2;"C";2024-01-02;7;n/a\n'
                                          '3;x;01/02/2024;8;1.5\n4;y;bad;9;2;9\nCNPJ_FUNDO;NM;DT_COMPTC;NR_COTST;VL_QUOTA\n')
    rows, headers = scan_csv_tree(spark, str(tmp_path / "q"))
    assert sorted(r.NM for r in columns_from_fields(rows, headers).collect()) == ['A; "B"', "C", "x"]
    got = {r.fund_cnpj: r for r in load_raw(spark, str(tmp_path / "q")).collect()}
    assert [str(got[i].report_date) for i in "123"] == ["2024-12-31", "2024-01-02", "2024-01-02"]
    assert got["1"].num_shareholders is None and got["2"].num_shareholders == 7 and got["1"].quota_value is None
    for width in (10, 70):       # a column that holds one missing token only goes, whatever the width
        d = tmp_path / str(width)
        d.mkdir()
        names = [f"C{i}" for i in range(width)]
        line = ["1"] * (width - 1) + ["n/a"]
        (d / "a.csv").write_text(";".join(["CNPJ_FUNDO", *names]) + "\n" + ";".join(["1", *line]) + "\n" + ";".join(["2", *line, "over"]) + "\n")
        out = load_raw(spark, str(d))
        assert f"c{width - 1}" not in out.columns and "c0" in out.columns and out.count() == 1


def test_layout_of_splits_plays_no_part(spark, tmp_path):
    from fundlens.sources.files import scan_csv_tree

    for i in range(6):
        (tmp_path / f"f{i}.csv").write_text("ID;V\n" + "".join(f"{i}{j};{j}\n" for j in range(500)))
    rows, _ = scan_csv_tree(spark, str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert rows.count() == 3000 and scan_csv_tree(spark, str(tmp_path))[0].count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_failed_read_leaves_the_table(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from fundlens.operators.dedupe import upsert_partitions

    path = str(tmp_path / "t")
    row = "fund_cnpj string, report_date date, quota_value double, month string"
    first = spark.createDataFrame([("a", D0, 1.0, "2024-01"), ("a", D0, 2.0, "2024-01"), ("b", D0, 3.0, "2024-01")], row)
    upsert_partitions(spark, path, first)
    assert sorted((r.fund_cnpj, r.quota_value) for r in spark.read.parquet(path).collect()) == [("a", 2.0), ("b", 3.0)]
    plain = DataFrameReader.parquet

    def broken(self, *paths, **kw):
        if paths == (path,):
            raise OSError("the store does not answer")
        return plain(self, *paths, **kw)
    monkeypatch.setattr(DataFrameReader, "parquet", broken)
    with pytest.raises(OSError):
        upsert_partitions(spark, path, spark.createDataFrame([("a", D0, 9.0, "2024-01")], row))
    monkeypatch.undo()
    assert sorted((r.fund_cnpj, r.quota_value) for r in spark.read.parquet(path).collect()) == [("a", 2.0), ("b", 3.0)]
