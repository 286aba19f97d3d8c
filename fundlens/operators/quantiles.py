"""Exact order statistics without a single-task sort.

``percentile()`` over a whole column merges every distinct value into one buffer, and
``percentile_approx`` is wrong in the far tail (C4 needs the 0.99999 quantile exactly). Here the
rank is located by histogram narrowing: each round is one scan with a map-side ``groupBy(target,
bucket)`` whose result is at most ``targets x buckets`` rows; the value range of the bucket that
holds the rank becomes the next round's range. The first round buckets by sign and power of two, the
later ones cut the remaining range (of one power of two) in 1024 equal parts, so seven rounds reach
a single double whatever the values' spread. When a bucket holds few enough rows (or one distinct
value) its values are fetched and the exact order statistic is read off. Results equal linear
interpolation between the two neighbouring order statistics (numpy / pandas / Spark ``percentile``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 1024
FETCH_LIMIT = 20_000


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(k, v) pairs for the non-NULL, non-NaN values of ``cols``."""
    cols = list(cols)
    src = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = src.unpivot([], cols, "k", "v") if len(cols) > 1 else \
        src.select(F.lit(cols[0]).alias("k"), F.col(cols[0]).alias("v"))
    return long.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _select_ranks(long: DataFrame, targets: dict[int, tuple[str, int]], stats: dict) -> dict[int, float]:
    """Exact value at 0-based ``rank`` (over all non-NULL values incl. +-inf) per target id."""
    out: dict[int, float] = {}
    state = {}
    for tid, (k, rank) in targets.items():
        n_neg, n_fin, lo, hi = stats[k]["neg"], stats[k]["fin"], stats[k]["lo"], stats[k]["hi"]
        if rank < n_neg:
            out[tid] = -math.inf
        elif rank >= n_neg + n_fin:
            out[tid] = math.inf
        elif lo == hi:
            out[tid] = lo
        else:
            state[tid] = {"k": k, "rank": rank - n_neg, "lo": lo, "hi": hi, "n": n_fin, "coarse": True}
    finite = long.where(~F.col("v").isin(float("inf"), float("-inf")))

    def tagged(targets_):
        # one row per (value, target of its column whose [lo, hi] range holds it)
        per: dict[str, list] = {}
        for t, st in targets_.items():
            per.setdefault(st["k"], []).append(F.struct(F.lit(t).alias("tid"), F.lit(st["lo"]).alias("lo"), F.lit(st["hi"]).alias("hi"),
                                                        F.lit(st["coarse"]).alias("coarse")))
        of = F.create_map(*[x for k, ts in per.items() for x in (F.lit(k), F.array(*ts))])
        mine = F.filter(F.try_element_at(of, F.col("k")), lambda t: (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))
        return finite.where(F.col("k").isin(*per)).select("v", F.explode(mine).alias("t")).select("v", "t.*")

    while state:
        fetch = {t: s for t, s in state.items() if s["n"] <= FETCH_LIMIT}
        narrow = {t: s for t, s in state.items() if t not in fetch}
        if fetch:
            got = tagged(fetch).toPandas()  # <= FETCH_LIMIT values per target (Arrow transfer)
            for t, s in fetch.items():
                vs = got.loc[got["tid"] == t, "v"].sort_values(kind="stable").to_numpy()
                out[t] = float(vs[s["rank"]])
                del state[t]
        if narrow:
            power = F.floor(F.log2(F.abs(F.col("v")))) + 2000       # positive for every finite double
            signed = F.when(F.col("v") == 0, F.lit(0)).when(F.col("v") > 0, power).otherwise(-power)
            part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
            bucket = F.when(F.col("coarse"), signed).otherwise(part).cast("int")
            hist = (tagged(narrow).groupBy("tid", bucket.alias("b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                    .collect())  # <= targets x BUCKETS rows
            per: dict[int, list] = {}
            for r in hist:
                per.setdefault(r["tid"], []).append((r["b"], r["c"], r["mn"], r["mx"]))
            for t, s in narrow.items():
                seen = 0
                for b, c, mn, mx in sorted(per.get(t, [])):
                    if seen + c > s["rank"]:
                        s.update(rank=s["rank"] - seen, lo=mn, hi=mx, n=c, coarse=False)
                        break
                    seen += c
                if s["lo"] == s["hi"]:
                    out[t] = s["lo"]
                    del state[t]
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    materialize: bool = True) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles of each column (NULL/NaN skipped). None for an empty column.

    ``materialize`` checkpoints the (k, v) column once so each narrowing round rescans a written
    table instead of recomputing the input plan; pass False when the input is already materialised."""
    long = long_values(df, cols)
    if materialize:
        long = cut_lineage(long)
    inf = float("inf")
    agg = long.groupBy("k").agg(
        F.count(F.when(F.col("v") == -inf, 1)).alias("neg"),
        F.count(F.when((F.col("v") != inf) & (F.col("v") != -inf), 1)).alias("fin"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.when((F.col("v") != inf) & (F.col("v") != -inf), F.col("v"))).alias("lo"),
        F.max(F.when((F.col("v") != inf) & (F.col("v") != -inf), F.col("v"))).alias("hi")).collect()
    stats = {r["k"]: r.asDict() for r in agg}
    targets: dict[int, tuple[str, int]] = {}
    plan: dict[tuple[str, float], tuple[int, int | None, float] | None] = {}
    index: dict[tuple[str, int], int] = {}

    def tid_for(k, rank):
        if (k, rank) not in index:
            index[(k, rank)] = len(index)
            targets[index[(k, rank)]] = (k, rank)
        return index[(k, rank)]

    for c in cols:
        n = stats.get(c, {}).get("n", 0)
        for p in probs:
            if not n:
                plan[(c, p)] = None
                continue
            h = (n - 1) * p
            r1 = int(math.floor(h))
            frac = h - r1
            r2 = r1 + 1 if frac > 0 and r1 + 1 < n else None
            plan[(c, p)] = (tid_for(c, r1), tid_for(c, r2) if r2 is not None else None, frac)
    values = _select_ranks(long, targets, stats) if targets else {}
    result: dict[tuple[str, float], float | None] = {}
    for key, pl in plan.items():
        if pl is None:
            result[key] = None
            continue
        t1, t2, frac = pl
        v1 = values[t1]
        if t2 is None:
            result[key] = v1
        else:
            v2 = values[t2]
            result[key] = v1 + (v2 - v1) * frac if v1 != v2 else v1
    return result


def kth_smallest(df: DataFrame, col: str, k: int, materialize: bool = True) -> float:
    """The exact k-th smallest (0-based) non-NULL value of ``col``."""
    long = long_values(df, [col])
    if materialize:
        long = cut_lineage(long)
    inf = float("inf")
    r = long.agg(F.count(F.when(F.col("v") == -inf, 1)).alias("neg"),
                 F.count(F.when((F.col("v") != inf) & (F.col("v") != -inf), 1)).alias("fin"),
                 F.min(F.when((F.col("v") != inf) & (F.col("v") != -inf), F.col("v"))).alias("lo"),
                 F.max(F.when((F.col("v") != inf) & (F.col("v") != -inf), F.col("v"))).alias("hi")).first()
    return _select_ranks(long, {0: (col, k)}, {col: r.asDict()})[0]
