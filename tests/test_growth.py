"""Steps whose cost grew faster than their input: each is done once, in bounded pieces, with equal results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _from(df, part):
    return [f for f in df.inputFiles() if part in f]


def test_labelings_of_the_same_points_share_distances(spark, monkeypatch):
    from fundlens.operators import evaluate as EV

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(6, 1, (20, 2)), [[6.0, 6.0]] * 3]) * [1.0, 1e4] + [0.0, 1e7]
    rows = [(d, k, f"p{i}", int(i * k // len(x)), [float(v) for v in x[i]]) for d in "ab" for k in (2, 3, 5) for i in range(len(x)) if d == "a" or i % 3]
    df = spark.createDataFrame(rows, "d string, k int, id string, lab int, x array<double>")
    one = {(r.d, r.k): r.silhouette_score for r in EV.silhouette(df, "lab", "x", "id", ["k", "d"], block_rows=8).collect()}
    all_ = EV.silhouette(df, "lab", "x", "id", ["k", "d"], block_rows=8, labelings=["k"])
    got = {(r.d, r.k): r.silhouette_score for r in all_.collect()}
    assert set(got) == set(one) and all(math.isclose(got[c], one[c], rel_tol=1e-9) for c in one)
    for (d, k), score in got.items():
        at = [i for i in range(len(x)) if d == "a" or i % 3]
        lab, dist = np.array([i * k // len(x) for i in at]), np.sqrt(((x[at][:, None] - x[at][None]) ** 2).sum(-1))
        s = []
        for i in range(len(at)):
            a = dist[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
            b = min(dist[i, lab == o].mean() for o in set(lab) - {lab[i]})
            s.append((b - a) / max(a, b))
        assert math.isclose(score, float(np.mean(s)), rel_tol=1e-9)


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e9])
def test_distances_of_close_points_do_not_cancel(scale):
    from fundlens.operators.evaluate import _distances

    rng = np.random.default_rng(8)
    a = rng.normal(0, 1, (70, 64)) * scale
    b = np.concatenate([a[:9] * (1 + 1e-9), a[20:25], rng.normal(0, 1, (300, 64)) * scale])
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert np.allclose(_distances(a, b), want, rtol=1e-11, atol=0)


def test_extreme_returns_read_their_input_once(spark, tmp_path):
    from fundlens.operators.clean import filter_extreme_returns

    rows = [(f"{f:02d}", d, 1.0 + (d * (f + 3)) % 7 + (900.0 if (f, d) == (4, 6) else 0.0)) for f in range(8) for d in range(12)]
    path = str(tmp_path / "panel-of-test")
    spark.createDataFrame(rows, "fund_cnpj string, report_date int, quota_value double").write.parquet(path)
    out = filter_extreme_returns(spark.read.parquet(path), 0.99, 0.0, write_rows=True)
    assert not _from(out, "panel-of-test")
    assert out.select("fund_cnpj").distinct().count() == 7 and out.where("fund_cnpj = '04'").isEmpty()


def test_median_keeps_no_values(spark):
    from fundlens.operators.aggregate import aggregate_features
    from fundlens.operators.features import create_features

    rng = np.random.default_rng(3)
    rows = [(f"{f}", f"2000-01-{d + 1:02d}", None if (d * 7 + f) % 9 == 0 else float(rng.integers(1, 6)) * (d != 5 or f != 2), 2.0, 1.0, 0.0, 0.0, 1) for f in range(6) for d in range(9 + f)]
    p = spark.createDataFrame(rows, "fund_cnpj string, report_date string, quota_value double, total_value double, net_asset_value double, "
                                    "daily_inflow double, daily_redemptions double, num_shareholders int")
    daily = create_features(p.withColumn("report_date", F.to_date("report_date")), dedupe=False)
    out = aggregate_features(daily, drop_threshold=None)
    assert "ObjectHashAggregate" not in _plan(out)
    want = {r.fund_cnpj: r.m for r in daily.groupBy("fund_cnpj").agg(F.median("return").alias("m")).collect()}
    assert any(math.isinf(r["return"]) for r in daily.where("return IS NOT NULL").collect())
    for r in out.collect():
        m = want[r.fund_cnpj]
        assert r.median_return == (None if m is None or math.isinf(m) else pytest.approx(m, abs=1e-12))


def test_csv_records_are_parsed_once(spark, tmp_path):
    from fundlens.plans.load import load_panel, load_raw

    root = tmp_path / "csv-of-test"
    root.mkdir()
    (root / "a.csv").write_text("CNPJ_FUNDO;DT_COMPTC;VL_QUOTA;VL_QUOTA;NR_COTST;ID_SUBCLASSE\n1;2024-01-02;1.5;9;3;\n1;2024-01-02;2.5;9;4;\n2;2024-01-03;n/a\n")
    (root / "b.csv").write_text("VL_QUOTA;CNPJ.FUNDO;DT_COMPTC;X\n7;1;2024-02-01;x;y\n8;3;2024-02-01;\n")
    raw = load_raw(spark, str(root))
    assert not _from(raw, "csv-of-test")
    got = sorted(((r.fund_cnpj, str(r.report_date), r.quota_value, r.num_shareholders) for r in raw.collect()), key=str)
    assert got == [("1", "2024-01-02", 1.5, 3), ("1", "2024-01-02", 2.5, 4), ("2", "2024-01-03", None, None), ("3", "2024-02-01", 8.0, None)]
    assert not {"id_subclasse", "x"} & set(raw.columns)
    sampled = load_raw(spark, str(root), sample_size=100)
    assert sorted(map(str, sampled.select(*raw.columns).collect())) == sorted(map(str, raw.collect()))
    panel = load_panel(spark, str(root))
    assert not _from(panel, "typed-rows")
    assert sorted((r.fund_cnpj, r.quota_value, r.max_monthly_appearances) for r in panel.where("quota_value IS NOT NULL").collect()) == [("1", 2.5, 1), ("3", 8.0, 1)]


def test_yearly_files_are_written_without_a_sort(spark, tmp_path):
    from fundlens.session import open_writers

    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, rows = spark.conf.get(name), [(i % 3, i) for i in range(300)]
    with open_writers(spark):
        assert int(spark.conf.get(name)) > 3
        spark.createDataFrame(rows, "y int, v int").repartition("y").write.partitionBy("y").csv(str(tmp_path / "t"))
    assert spark.conf.get(name) == before
    assert all(len(list((tmp_path / "t" / f"y={y}").glob("*.csv"))) == 1 for y in range(3))
    assert sorted((r.y, r.v) for r in spark.read.schema("v int, y int").csv(str(tmp_path / "t")).collect()) == sorted(rows)


def test_samples_do_not_shuffle_rows(spark):
    from fundlens.sources.files import sample_per_file

    df = spark.range(50).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("fields"))
    assert _plan(sample_per_file(df, 5)).count("Exchange hashpartitioning") == 1     # the counts


def test_lines_are_numbered_in_their_scan(spark, tmp_path):
    from fundlens.sources.files import scan_csv_tree
    from fundlens.sources.records import numbered_lines, read_lines, without_returns

    body = "".join(f'{i};"x\n\ny;{i}"\n' if i % 3 else f"{i};z\n" for i in range(400))
    (tmp_path / "a.csv").write_text("ID;T\n" + body)
    (tmp_path / "b.csv").write_bytes("ID;T\n1;\"José\nA\"\n2;b\n".encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        plan = _plan(numbered_lines(without_returns(read_lines(spark, str(tmp_path), "*.csv")), ";"))
        assert "Exchange" not in plan and "Window" not in plan
        rows, _ = scan_csv_tree(spark, str(tmp_path))
        got = {(r.file[-5:], r.fields["ID"]): r.fields["T"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("a.csv", str(i)): f"x\n\ny;{i}" if i % 3 else "z" for i in range(400)} | {("b.csv", "1"): "José\nA", ("b.csv", "2"): "b"}
    assert got == want


def test_ranges_of_w1_follow_the_rows(spark, monkeypatch):
    from fundlens.operators import evaluate as EV

    rng = np.random.default_rng(4)
    u, v = rng.normal(0, 1, 150).round(2), rng.normal(1, 2, 130).round(2)
    monkeypatch.setattr(EV, "RANGE_ROWS", 10)
    out = EV.wasserstein_1d(*[spark.createDataFrame([(float(x),) for x in s], "x double") for s in (u, v)], "x")
    values = np.unique(np.concatenate([u, v]))
    want = sum(abs((u <= a).mean() - (v <= a).mean()) * (b - a) for a, b in zip(values, values[1:]))
    assert math.isclose(out.first()["wasserstein"], want, rel_tol=1e-9)
    ranges = spark.read.parquet(_from(out, "w1-ranges")[0].rsplit("/", 1)[0])
    assert ranges.select("_pid").distinct().count() > 8                # the session's shuffle partitions


def test_months_are_packed_as_lines(spark, tmp_path):
    from fundlens.plans.fixture_files import write_monthly_zips
    from fundlens.sources.files import read_monthly_quotas

    rows = [("202401", "1", "2024-01-02", 1.25e9, 2), ("202401", "a;b", "2024-01-01", None, 1), ("202402", 'q"x', "2024-02-01", 0.1, 3), (None, "9", None, 1.0, 4)]
    df = spark.createDataFrame(rows, "m string, CNPJ_FUNDO string, DT_COMPTC string, VL_QUOTA double, ID int")
    write_monthly_zips(df, str(tmp_path), "m", ["ID"], {"202402": ["CNPJ_FUNDO_CLASSE", "DT_COMPTC", "VL_QUOTA", "ID"]}, months=["202401", "202402"])
    got = read_monthly_quotas(spark, str(tmp_path)).withColumn("VL_QUOTA", F.col("VL_QUOTA").cast("double")).orderBy("DT_COMPTC")
    assert [(r.CNPJ_FUNDO, r.VL_QUOTA, r.line_no, r.file[-10:]) for r in got.collect()] == [
        ("a;b", None, 1, "202401.zip"), ("1", 1.25e9, 2, "202401.zip"), ('q"x', 0.1, 1, "202402.zip")]


def test_a_commit_evaluates_its_rows_once(spark, tmp_path):
    from fundlens.sources import month_table as T

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("1", "2024-01-01", 1.0, "2024-01"), ("1", "2024-02-01", 2.0, "2024-02")], "f string, d string, q double, month string")
    for n in (2, 4):
        T.commit(spark, str(tmp_path / "t"), rows.mapInArrow(count, rows.schema), ["f", "d"])
        assert seen.value == n
    assert T.read_table(spark, str(tmp_path / "t")).count() == 2


def test_a_step_of_a_single_fit_has_tasks_by_rows_not_by_files(spark, tmp_path, monkeypatch):
    from fundlens.operators import cluster as M

    path = str(tmp_path / "rows")
    rows = [(f"f{i}", d, float(i % 7), float(i % 5) * (i > 60)) for i in range(120) for d in ("train", "test")]
    spark.createDataFrame(rows, "fund_cnpj string, dataset string, a double, b double").repartition(40).write.parquet(path)
    monkeypatch.setattr(M, "FIT_TASK_ROWS", 30)
    tasks = []

    class Kept:
        def __init__(self, of):
            self.of = of

        def fit(self, df):
            tasks.append((df.rdd.getNumPartitions(), df.count()))
            return self.of.fit(df)

    spark.conf.set("spark.sql.files.openCostInBytes", "64m")        # a task for every two files
    try:
        for model in (M.gmm(2), M.kmeans(2)):
            out = M.fit_train_predict_all(spark.read.parquet(path), Kept(model))
            assert out.count() == 240 and out.where("pred IS NULL OR pred NOT IN (0, 1)").isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks == [(4, 120), (4, 120)]
    monkeypatch.setattr(M, "FIT_TASK_ROWS", 1000)
    assert M.in_few_tasks(spark.read.parquet(path)).rdd.getNumPartitions() == 1
    assert M.in_few_tasks(spark.read.parquet(path).limit(0)).count() == 0
