"""Fund-level cleaning filters.

Fund flags ride the per-fund window partitioning (``Window.partitionBy(fund)``), which the later
feature windows reuse, so dropping whole funds costs no join and no second shuffle. Each window
partition is one fund's rows, bounded by its dates once (fund, date) is unique (the canonical panel).
For raw, non-unique inputs ``method="aggregate"`` computes the flags with a map-side-combined
``groupBy`` and removes the funds with a size-checked broadcast anti join instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import drop_exact_duplicates, size_checked_broadcast
from .features import DATE, ID, add_return
from .quantiles import exact_quantiles


def drop_empty_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop a row whose ``subset`` columns (all columns if none) are all NULL."""
    return df.dropna(how="all", subset=list(subset) if subset else None)


def _drop_flagged(df: DataFrame, flag_of, id_col: str, method: str) -> DataFrame:
    """Remove every row of an id for which the boolean ``flag_of(agg)`` is true; ``agg`` wraps each
    aggregate (``.over(fund window)`` or a plain ``groupBy`` aggregate)."""
    if method == "window":
        w = Window.partitionBy(id_col)
        flagged = df.withColumn("__bad", F.coalesce(flag_of(lambda a: a.over(w)), F.lit(False)))
        return flagged.where(~F.col("__bad") | F.col(id_col).isNull()).select(*df.columns)
    if method == "aggregate":
        bad = df.groupBy(id_col).agg(flag_of(lambda a: a).alias("_bad")).where("_bad").select(id_col)
        return df.join(size_checked_broadcast(bad), on=id_col, how="left_anti")
    raise ValueError("method must be 'window' or 'aggregate'")


def filter_min_shareholders(df: DataFrame, cutoff: str, threshold: float = 100,
                            value_col: str = "num_shareholders", *, id_col: str = ID,
                            date_col: str = DATE, method: str = "window") -> DataFrame:
    """Drop a fund that, before ``cutoff``, ever had ``value_col <= threshold`` (NULL never
    violates), or whose first date is on/after ``cutoff``. Missing columns: no-op."""
    if not {id_col, date_col, value_col}.issubset(df.columns):
        return df
    cut = F.to_date(F.lit(cutoff.strip()))
    low = F.coalesce((F.col(date_col) < cut) & (F.col(value_col) <= threshold), F.lit(False))
    return _drop_flagged(df, lambda agg: agg(F.bool_or(low)) | (agg(F.min(date_col)) >= cut), id_col, method)


def filter_max_gap(df: DataFrame, max_gap: int = 6, *, id_col: str = ID, date_col: str = DATE) -> DataFrame:
    """Drop a fund whose largest gap between consecutive dates exceeds ``max_gap`` whole days
    (24 h floor when times are present). A single-row fund is kept."""
    if not {id_col, date_col}.issubset(df.columns):
        return df
    w = Window.partitionBy(id_col).orderBy(date_col)
    d = F.col(date_col)
    prev = F.lag(d).over(w)
    if dict(df.dtypes)[date_col] == "date":
        gap = F.datediff(d, prev)
    else:
        gap = F.floor((F.unix_micros(d.cast("timestamp")) - F.unix_micros(prev.cast("timestamp")))
                      / F.lit(86_400_000_000))
    g = "__gap"
    out = df.withColumn(g, gap)
    out = out.withColumn("__maxgap", F.max(g).over(Window.partitionBy(id_col)))
    return out.where(F.col("__maxgap").isNull() | (F.col("__maxgap") <= max_gap)).select(*df.columns)


def filter_extreme_returns(df: DataFrame, upper_q: float = 0.99999, lower_q: float = 0.00001,
                           col: str = "quota_value", *, id_col: str = ID, date_col: str = DATE,
                           write_rows: bool = False) -> DataFrame:
    """C4: drop a fund with any return strictly outside the *global* exact quantiles
    [lower_q, upper_q] of all non-NULL returns; all-NULL returns leave the input unchanged.

    The two thresholds are fitted scalars (exact, by histogram narrowing); the fund flag is a window
    max over the fund partition that later windows use as well. Only the returns are written for the
    search, or with ``write_rows`` the rows, so that the plan below them runs once, for the search and for
    what follows."""
    from ..session import write_table

    with_ret = add_return(df, col, out="__ret", id_col=id_col, date_col=date_col)
    returns = write_table(with_ret if write_rows else with_ret.select("__ret"), "returns")
    with_ret = returns if write_rows else with_ret
    q = exact_quantiles(returns, ["__ret"], [upper_q, lower_q], materialize=False)
    upper, lower = q[("__ret", upper_q)], q[("__ret", lower_q)]
    if upper is None:
        return with_ret.select(*df.columns)
    out_of_band = F.coalesce((F.col("__ret") > F.lit(upper)) | (F.col("__ret") < F.lit(lower)), F.lit(False))
    flagged = with_ret.withColumn("__bad", F.bool_or(out_of_band).over(Window.partitionBy(id_col)))
    return flagged.where(~F.col("__bad")).select(*df.columns)


def flag_outliers(df: DataFrame, params: dict | None = None) -> DataFrame:
    """Identity unless configured. ``params={"columns": [...], "k": 1.5}`` adds
    ``<col>_is_outlier`` = outside [q1 - k*IQR, q3 + k*IQR] with exact global quartiles."""
    if not params:
        return df
    cols = list(params.get("columns", []))
    k = float(params.get("k", 1.5))
    q = exact_quantiles(df, cols, [0.25, 0.75], materialize=True)
    out = df
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            out = out.withColumn(f"{c}_is_outlier", F.lit(None).cast("boolean"))
            continue
        iqr = q3 - q1
        out = out.withColumn(f"{c}_is_outlier",
                             (F.col(c) < F.lit(q1 - k * iqr)) | (F.col(c) > F.lit(q3 + k * iqr)))
    return out


@dataclass
class CleanConfig:
    required_columns: list[str] = field(default_factory=lambda: [ID, DATE])
    cutoff: str = "2025-06-01"
    min_value: float = 100
    min_value_col: str = "num_shareholders"
    max_gap: int = 6
    outlier_params: dict = field(default_factory=dict)
    upper_q: float = 0.99999
    lower_q: float = 0.00001
    write_rows: bool = False    # C4 writes the rows that it searches; what follows reads these


def clean(df: DataFrame, config: CleanConfig | None = None, *, id_col: str = ID,
          date_col: str = DATE) -> DataFrame:
    """Require -> C1 -> K4 -> C2 -> C3 -> C5 -> C4."""
    cfg = config or CleanConfig()
    missing = [c for c in cfg.required_columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    out = drop_empty_rows(df, cfg.required_columns or None)
    out = drop_exact_duplicates(out)
    out = filter_min_shareholders(out, cfg.cutoff, cfg.min_value, cfg.min_value_col,
                                  id_col=id_col, date_col=date_col)
    out = filter_max_gap(out, cfg.max_gap, id_col=id_col, date_col=date_col)
    out = flag_outliers(out, cfg.outlier_params)
    return filter_extreme_returns(out, cfg.upper_q, cfg.lower_q, id_col=id_col, date_col=date_col, write_rows=cfg.write_rows)


def null_summary(df: DataFrame) -> DataFrame:
    """V5: rows, columns and NULL count per column, as (column, nulls) rows plus totals."""
    n_cols = len(df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stack = counts.unpivot(["__rows"], df.columns, "column", "nulls") if df.columns else counts
    return stack.select(F.col("__rows").alias("rows"), F.lit(n_cols).alias("columns"), "column", "nulls")

