"""V6: counts, moments, distinct values and quartiles of many columns from one packing of the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

INF, NAN = math.inf, math.nan


def _close(a, b, abs_tol=0.0):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-15, abs_tol=abs_tol)))


def _expected(values, probs):
    v = np.array([x for x in values if x is not None], float)
    real = np.sort(v[~np.isnan(v)])
    with np.errstate(all="ignore"):
        std = float(v.std(ddof=1)) if len(v) > 1 else NAN
        mean = float(v.mean()) if len(v) else None
    q = []
    for p in probs if len(real) else ():
        h = (len(real) - 1) * p
        a, b = real[math.floor(h)], real[math.ceil(h)]
        q.append(float(a + (b - a) * (h - math.floor(h)) if a != b else a))
    return {"rows": len(values), "n": len(v), "mean": mean, "std": None if math.isnan(std) else std,
            "min": float(real[0]) if len(real) else NAN if len(v) else None,
            "max": NAN if len(real) < len(v) else float(real[-1]) if len(real) else None,
            "unique": len(np.unique(real)) + (len(real) < len(v)), "quantiles": q or [None] * len(probs)}


@pytest.mark.parametrize("sizes", [(64, 8, 16), (7, 3, 1), (1 << 19, 1 << 13, 1 << 20)])
def test_profiles_match_numpy_for_any_run_segment_and_bucket(spark, sizes):
    from fundlens.operators.profiles import column_profiles

    rng, n = np.random.default_rng(11), 700
    cols = {"spread": [float(x) for x in rng.lognormal(0, 60, n) * rng.choice([-1, 1], n)],
            "narrow": [1.0 + k * 2.0 ** -52 for k in rng.permutation(n).tolist()],      # neighbouring doubles
            "hot": [0.0 if i % 3 else float(rng.integers(40)) for i in range(n)],       # one value holds two thirds
            "zeros": [(0.0, -0.0, 1.5)[i % 3] for i in range(n)],
            "missing": [None if i % 5 else float(i) for i in range(n)],
            "nans": [NAN if i % 4 == 0 else float(i % 9) for i in range(n)],
            "infinite": [INF if i % 2 else -INF if i == 8 else float(i) for i in range(n)],
            "all_null": [None] * n, "all_nan": [NAN] * n, "one": [7.5 if i == 3 else None for i in range(n)]}
    df = spark.createDataFrame([*zip(*cols.values(), strict=True)], ", ".join(f"{c} double" for c in cols)).repartition(3)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    for (c, values), got in zip(cols.items(), column_profiles(df, list(cols), probs, *sizes), strict=True):
        want = _expected(values, probs)
        assert set(got) == set(want)
        for k in ("rows", "n", "min", "max", "unique"):
            assert _close(got[k], want[k]), (c, k, got[k], want[k])
        assert all(map(_close, got["quantiles"], want["quantiles"])), (c, got["quantiles"], want["quantiles"])
        for k in ("mean", "std"):                                     # sums in another order
            assert _close(got[k], want[k], max(abs(x) for x in values if x is not None and math.isfinite(x)) * 1e-13
                          if want[k] is not None and math.isfinite(want[k]) else 0.0), (c, k, got[k], want[k])
    for got in column_profiles(df.where("spread > 1e300"), ["hot", "nans"], [0.5], *sizes):
        assert got == {"rows": 0, "n": 0, "mean": None, "std": None, "min": None, "max": None, "unique": 0, "quantiles": [None]}


def test_buckets_follow_the_values_not_their_repeats():
    from fundlens.operators.profiles import _cuts

    rng = np.random.default_rng(2)
    v = np.sort(rng.normal(1.0, 1e-9, 200_000))
    sizes = np.diff([0, *np.searchsorted(v, _cuts(rng.choice(v, 2_000), len(v), 10_000)), len(v)])
    assert len(sizes) == 20 and sizes.max() < 20_000
    assert _cuts(np.full(50, 3.0), 5_000, 100).tolist() == [3.0]      # equal values are never parted
    assert not len(_cuts(np.zeros(0), 0, 100))


def test_summary_takes_few_jobs_whatever_the_spread(spark, monkeypatch):
    from fundlens.operators import quality as V
    from fundlens.operators import quantiles as Q

    monkeypatch.setattr(Q, "FETCH_LIMIT", 5)      # a search by rounds would scan the rows once for each
    df = spark.range(4_000).select((F.lit(1.0) + F.col("id") * F.lit(2.0 ** -50)).alias("return"), F.exp(F.col("id") % 600).alias("drawdown"),
                                   F.col("id").cast("int").alias("time_in_drawdown"))
    sc = spark.sparkContext
    sc.setJobGroup("summary-of-test", "V6")
    try:
        rows = {r["column"]: r for r in V.feature_summary(df).collect()}
        jobs = sc.statusTracker().getJobIdsForGroup("summary-of-test")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10, len(jobs)
    assert [rows[c]["unique_count"] for c in ("return", "drawdown", "time_in_drawdown")] == [4_000, 600, 4_000]
    assert rows["time_in_drawdown"]["p25"] == 999.75 and rows["return"]["p50"] == 1.0 + 1999.5 * 2.0 ** -50
