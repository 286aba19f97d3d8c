"""Fund-level aggregation of the daily features.

One ``groupBy(*by, fund)`` computes all aggregates; it reuses the hash partitioning of the
feature windows, so no further Exchange is planned. ``median`` is exact per fund (its buffer is
bounded by the dates of one fund).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import adjusted_kurt, adjusted_skew, inf_to_null, nan_to_null, safe_divide, stddev_samp
from .features import DATE, DEFAULT_WINDOWS, ID


def _corr(x: str, y: str, mode: str, min_periods: int) -> Column:
    """A4. ``pairwise``: Pearson r on rows where both are non-null (at least ``min_periods``
    pairs, non-zero spread). ``strict``: NULL as soon as any value is missing or n < 2."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs = F.when(both, F.col(x))
    ys = F.when(both, F.col(y))
    n_pairs = F.count(xs)
    ok_spread = (F.var_pop(xs) > 0) & (F.var_pop(ys) > 0)
    # not ``corr``: evaluated in generated code, it divides by a zero spread before the condition is asked
    r = nan_to_null(F.try_divide(F.covar_pop(xs, ys), F.sqrt(F.var_pop(xs)) * F.sqrt(F.var_pop(ys))))
    if mode == "pairwise":
        return F.when((n_pairs >= F.lit(max(2, min_periods))) & ok_spread, r)
    if mode == "strict":
        return F.when((F.count(F.lit(1)) > 1) & (n_pairs == F.count(F.lit(1))) & ok_spread, r)
    raise ValueError(f"corr mode must be 'pairwise' or 'strict', got {mode!r}")


def base_aggregate_specs(windows: Sequence[int] = DEFAULT_WINDOWS) -> list[tuple[str, Column]]:
    """A1-A3: the per-fund aggregates (19 for three windows), as (name, expression)."""
    r = "return"
    specs = [
        ("mean_return", F.avg(r)),
        ("median_return", F.median(r)),
        ("std_return", stddev_samp(r)),
        ("skew_return", adjusted_skew(r)),
        ("kurt_return", adjusted_kurt(r)),
        ("max_drawdown", F.max("drawdown")),
        ("avg_drawdown", F.avg("drawdown")),
        ("avg_time_drawdown", F.avg("time_in_drawdown")),
        ("max_time_drawdown", F.max("time_in_drawdown")),
        ("avg_gross_by_net", F.avg("gross_by_net")),
        ("avg_inflow", F.avg("daily_inflow")),
        ("avg_redemption", F.avg("daily_redemptions")),
        ("avg_shareholders", F.avg("num_shareholders")),
    ]
    specs += [(f"mean_std_{w}", F.avg(f"vol_{w}")) for w in windows]
    specs += [(f"std_std_{w}", stddev_samp(f"vol_{w}")) for w in windows]
    return specs


def base_aggregates(windows: Sequence[int] = DEFAULT_WINDOWS) -> list[Column]:
    return [expr.alias(name) for name, expr in base_aggregate_specs(windows)]


def ratio_columns(windows: Sequence[int] = DEFAULT_WINDOWS) -> list[tuple[str, Column]]:
    """A5: derived ratios with the safe-divide rule (denominator 0 -> NULL)."""
    m = F.col("mean_return")
    out = [("sharpe", safe_divide(m, F.col("std_return")))]
    out += [(f"sharpe_mean_std_{w}", safe_divide(m, F.col(f"mean_std_{w}"))) for w in windows]
    out += [
        ("ret_by_DD", safe_divide(m, F.abs(F.col("avg_drawdown")))),
        ("ret_by_max_DD", safe_divide(m, F.abs(F.col("max_drawdown")))),
        ("ret_by_timedd", safe_divide(m, F.col("avg_time_drawdown"))),
        ("ret_by_timedd_max", safe_divide(m, F.col("max_time_drawdown"))),
    ]
    ws = list(windows)
    out += [(f"volatility_ratio_{a}_{b}", safe_divide(F.col(f"mean_std_{a}"), F.col(f"mean_std_{b}")))
            for a, b in zip(ws, ws[1:])]
    return out


def feature_columns(windows: Sequence[int] = DEFAULT_WINDOWS) -> list[str]:
    """Names of the fund-level features, in order (32 for three windows)."""
    names = [n for n, _ in base_aggregate_specs(windows)]
    names += [f"corr_return_vol{w}" for w in windows]
    names += [n for n, _ in ratio_columns(windows)]
    return names


def with_middle_values(df: DataFrame, col: str, keys: Sequence[str], out: str) -> DataFrame:
    """``out``: the value of ``col`` in the middle row (or both) of the non-NULL values of its group, else
    NULL. The rows leave the windows by date again, the order in which the aggregates add them up."""
    group = Window.partitionBy(*keys)
    whole = group.orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if DATE in df.columns else group
    ranked = df.withColumn("__rank", F.row_number().over(group.orderBy(F.col(col).asc_nulls_last()))).withColumn("__n", F.count(col).over(whole))
    middle = [f((F.col("__n") + 1) / 2) for f in (F.floor, F.ceil)]
    return ranked.withColumn(out, F.when(F.col("__rank").isin(*middle), F.col(col))).drop("__rank", "__n")


def aggregate_features(daily: DataFrame, *, windows: Sequence[int] = DEFAULT_WINDOWS,
                       drop_threshold: float | None = 0.5, corr_mode: str = "pairwise",
                       min_periods_for_correlation: int = 2, by: Sequence[str] = (),
                       id_col: str = ID, drop_empty_columns: bool = False) -> DataFrame:
    """A1 -> A4 -> A5 -> A6 (inf -> NULL) -> A7 (drop sparse funds) [-> N2].

    ``drop_empty_columns`` runs N2 (a driver decision over one count job); it changes the schema,
    so it is off by default.
    """
    keys = [*by, id_col]
    # A1's median is the mean of the middle rows: all aggregates then keep buffers of fixed size
    daily = with_middle_values(daily, "return", keys, "__mid")
    aggs = [(F.avg("__mid") if name == "median_return" else expr).alias(name) for name, expr in base_aggregate_specs(windows)]
    aggs += [_corr("return", f"vol_{w}", corr_mode, min_periods_for_correlation).alias(f"corr_return_vol{w}")
             for w in windows]
    out = daily.groupBy(*keys).agg(*aggs)
    for name, expr in ratio_columns(windows):
        out = out.withColumn(name, expr)
    feats = [c for c in out.columns if c not in keys]
    # +-inf (and any NaN) -> NULL; integer columns are untouched
    dtypes = dict(out.dtypes)
    out = out.select(*keys, *[inf_to_null(c).alias(c) if dtypes[c] in ("double", "float") else F.col(c)
                              for c in feats])
    if drop_threshold is not None:
        out = drop_sparse_rows(out, feats, drop_threshold)
    if drop_empty_columns:
        from .normalize import drop_all_null_columns

        out = drop_all_null_columns(out)
    return out


def drop_sparse_rows(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Keep a row iff its fraction of NULLs over ``cols`` is at most ``threshold``."""
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.where(nulls / F.lit(float(len(cols))) <= F.lit(threshold))


def dropna_any(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop a row with any NULL feature.

    Written as a NULL-count predicate rather than ``dropna``: on the wide, deeply nested feature
    projection, ``dropna`` makes the optimizer infer and alias-substitute one IsNotNull constraint
    per column, which grows combinatorially in planning time."""
    cols = list(subset) if subset else df.columns
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.where(nulls == 0)
