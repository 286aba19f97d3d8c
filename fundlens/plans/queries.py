"""Query registry, part 1: daily features (F*) and fund aggregation (A*).

The registry behind ``__spark_entry__``: one Spark query and (where SQL can say it) one DuckDB
oracle per operator of the inventory. Every query reads the driver's tables (or data Spark derives
from them) over whole tables. Doubles are rounded to 6 dp on both sides for value hashing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import inf_to_null, safe_divide
from ..operators import aggregate as A
from ..operators import features as FE
from . import sql_snippets as S
from .views import panel

from .registry import ORACLES, QUERIES, register  # noqa: F401


def _rounded(select_list: list[tuple[str, bool]]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if dbl else c for c, dbl in select_list)


def daily(spark, sf_dir, features=None):
    return FE.create_features(panel(spark, sf_dir), features, dedupe=False)


def _daily_sql(select: str, where: str = "") -> str:
    return f"WITH {S.PANEL_CTE},{S.daily_features_sql('panel')}\nSELECT {select} FROM d8 {where}"


# ------------------------------------------------------------------ F: daily features

@register("f1_safe_divide", _daily_sql(
    "fund_cnpj, report_date, round(CASE WHEN daily_inflow <> 0 THEN daily_redemptions / daily_inflow END, 6)"
    " AS redemption_to_inflow"))
def f1_safe_divide(spark, sf_dir):
    """redemptions / inflow, NULL where the day had no inflow."""
    return panel(spark, sf_dir).select(
        "fund_cnpj", "report_date",
        safe_divide("daily_redemptions", "daily_inflow").alias("redemption_to_inflow"))


@register("f2_daily_return", _daily_sql('fund_cnpj, report_date, round("return", 6) AS "return"'))
def f2_daily_return(spark, sf_dir):
    """forward-filled percent change of the quota per fund."""
    return daily(spark, sf_dir, ["returns"]).select("fund_cnpj", "report_date", "return")


@register("f3_gross_by_net", _daily_sql("fund_cnpj, report_date, round(gross_by_net, 6) AS gross_by_net"))
def f3_gross_by_net(spark, sf_dir):
    return daily(spark, sf_dir, ["gross_by_net"]).select("fund_cnpj", "report_date", "gross_by_net")


@register("f4_rolling_vol", _daily_sql(
    "fund_cnpj, report_date, round(vol_5, 6) AS vol_5, round(vol_10, 6) AS vol_10, round(vol_15, 6) AS vol_15"))
def f4_rolling_vol(spark, sf_dir):
    return daily(spark, sf_dir, ["volatility"]).select("fund_cnpj", "report_date", "vol_5", "vol_10", "vol_15")


@register("f5_drawdown", _daily_sql("fund_cnpj, report_date, round(drawdown, 6) AS drawdown"))
def f5_drawdown(spark, sf_dir):
    return daily(spark, sf_dir, ["drawdown"]).select("fund_cnpj", "report_date", "drawdown")


@register("f6_time_in_drawdown", _daily_sql("fund_cnpj, report_date, time_in_drawdown"))
def f6_time_in_drawdown(spark, sf_dir):
    return daily(spark, sf_dir, ["time_in_drawdown"]).select("fund_cnpj", "report_date", "time_in_drawdown")


_DAILY_COLS = [("fund_cnpj", False), ("report_date", False), ("quota_value", True), ("total_value", True),
               ("net_asset_value", True), ("daily_inflow", True), ("daily_redemptions", True),
               ("num_shareholders", False), ('"return"', True), ("gross_by_net", True), ("vol_5", True),
               ("vol_10", True), ("vol_15", True), ("drawdown", True), ("time_in_drawdown", False)]


@register("f7_create_features", _daily_sql(_rounded(_DAILY_COLS)))
def f7_create_features(spark, sf_dir):
    """every daily feature, registry order, one Exchange + one Sort."""
    return daily(spark, sf_dir)


_MONTH_SQL = f"""WITH {S.PANEL_CTE},
m AS (SELECT fund_cnpj, report_date, strftime(report_date, '%m-%Y') AS month FROM panel),
a AS (SELECT *, count(fund_cnpj) OVER (PARTITION BY fund_cnpj, month) AS appearances_per_month FROM m),
x AS (SELECT *, max(appearances_per_month) OVER (PARTITION BY month) AS max_monthly_appearances FROM a)"""


@register("f8_month_label", _MONTH_SQL + "\nSELECT fund_cnpj, report_date, month FROM x")
def f8_month_label(spark, sf_dir):
    return FE.add_month_label(panel(spark, sf_dir)).select("fund_cnpj", "report_date", "month")


@register("f9_appearances_per_month",
          _MONTH_SQL + "\nSELECT fund_cnpj, report_date, month, appearances_per_month FROM x")
def f9_appearances_per_month(spark, sf_dir):
    df = FE.add_monthly_appearances(FE.add_month_label(panel(spark, sf_dir)))
    return df.select("fund_cnpj", "report_date", "month", "appearances_per_month")


@register("f10_max_monthly_appearances",
          _MONTH_SQL + "\nSELECT fund_cnpj, report_date, month, max_monthly_appearances FROM x")
def f10_max_monthly_appearances(spark, sf_dir):
    df = FE.add_monthly_appearances(FE.add_month_label(panel(spark, sf_dir)))
    return df.select("fund_cnpj", "report_date", "month", "max_monthly_appearances")


# ------------------------------------------------------------------ A: fund aggregation

def fund_features(spark, sf_dir, **kw):
    return A.aggregate_features(daily(spark, sf_dir), **kw)


def _agg_sql(select: str, where: str = "", strict_corr: bool = False) -> str:
    return (f"WITH {S.PANEL_CTE},{S.daily_features_sql('panel')},"
            f"{S.fund_aggregate_sql('d8', strict_corr=strict_corr)}\nSELECT {select} FROM g3 {where}")


def _r(names):
    return ", ".join(f"round({n}, 6) AS {n}" if n != "max_time_drawdown" else n for n in names)


_A1 = [n for n in S.FEATURE_NAMES_19 if n not in ("skew_return", "kurt_return")]


@register("a1_fund_stats", _agg_sql("fund_cnpj, " + _r(_A1)))
def a1_fund_stats(spark, sf_dir):
    """A1: mean / exact median / sample std / max per fund (17 columns)."""
    return fund_features(spark, sf_dir, drop_threshold=None).select("fund_cnpj", *_A1)


@register("a2_skew_return", _agg_sql("fund_cnpj, " + _r(["skew_return"])))
def a2_skew_return(spark, sf_dir):
    return fund_features(spark, sf_dir, drop_threshold=None).select("fund_cnpj", "skew_return")


@register("a3_kurt_return", _agg_sql("fund_cnpj, " + _r(["kurt_return"])))
def a3_kurt_return(spark, sf_dir):
    return fund_features(spark, sf_dir, drop_threshold=None).select("fund_cnpj", "kurt_return")


@register("a4_corr_return_vol", _agg_sql("fund_cnpj, " + _r(S.CORR_NAMES)))
def a4_corr_return_vol(spark, sf_dir):
    """A4 (pairwise, the documented intent): Pearson r of return and each volatility."""
    return fund_features(spark, sf_dir, drop_threshold=None).select("fund_cnpj", *S.CORR_NAMES)


@register("a4_corr_return_vol_strict", _agg_sql("fund_cnpj, " + _r(S.CORR_NAMES), strict_corr=True))
def a4_corr_return_vol_strict(spark, sf_dir):
    """A4 (strict, the reference's observed result): NULL whenever a value is missing."""
    return fund_features(spark, sf_dir, drop_threshold=None, corr_mode="strict").select(
        "fund_cnpj", *S.CORR_NAMES)


@register("a5_derived_ratios", _agg_sql("fund_cnpj, " + _r(S.RATIO_NAMES)))
def a5_derived_ratios(spark, sf_dir):
    return fund_features(spark, sf_dir, drop_threshold=None).select("fund_cnpj", *S.RATIO_NAMES)


_A6_SQL = f"""WITH {S.PANEL_CTE},
f AS (SELECT *, last_value(daily_inflow IGNORE NULLS) OVER (PARTITION BY fund_cnpj ORDER BY report_date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _ff FROM panel),
p AS (SELECT *, lag(_ff) OVER (PARTITION BY fund_cnpj ORDER BY report_date) AS _prev FROM f),
c AS (SELECT fund_cnpj, report_date,
   CASE WHEN _ff IS NULL OR _prev IS NULL THEN NULL WHEN _prev <> 0 THEN _ff / _prev - 1
        WHEN _ff > 0 THEN CAST('inf' AS DOUBLE) WHEN _ff < 0 THEN CAST('-inf' AS DOUBLE) END AS inflow_change
   FROM p)
SELECT fund_cnpj, report_date, round(CASE WHEN isfinite(inflow_change) THEN inflow_change END, 6) AS inflow_change,
       isinf(inflow_change) AS was_infinite FROM c"""


@register("a6_inf_to_null", _A6_SQL)
def a6_inf_to_null(spark, sf_dir):
    """A6 on a series with zeros: percent change of daily inflow (x/0 -> inf) then inf -> NULL."""
    df = FE.add_return(panel(spark, sf_dir), "daily_inflow", out="inflow_change")
    return df.select("fund_cnpj", "report_date", inf_to_null("inflow_change").alias("inflow_change"),
                     (F.abs(F.col("inflow_change")) == F.lit(float("inf"))).alias("was_infinite"))


_ALL32_R = _r(S.ALL_32)


@register("a7_drop_sparse_rows", _agg_sql(
    "fund_cnpj, " + _ALL32_R, where=f"WHERE {S.null_fraction_sql()} <= 0.1", strict_corr=True))
def a7_drop_sparse_rows(spark, sf_dir):
    """A7 at threshold 0.1 with strict correlations (3 NULL columns of 32 always): keeps funds
    whose only NULLs are the correlations."""
    return fund_features(spark, sf_dir, corr_mode="strict", drop_threshold=0.1)


@register("a8_aggregate_features", _agg_sql("fund_cnpj, " + _ALL32_R,
                                            where=f"WHERE {S.null_fraction_sql()} <= 0.5"))
def a8_aggregate_features(spark, sf_dir):
    """The 32 fund-level features with the default 0.5 sparsity rule."""
    return fund_features(spark, sf_dir)


@register("a9_dropna_any", _agg_sql(
    "fund_cnpj, " + _ALL32_R,
    where=f"WHERE {S.null_fraction_sql()} <= 0.5 AND " + " AND ".join(f"{c} IS NOT NULL" for c in S.ALL_32)))
def a9_dropna_any(spark, sf_dir):
    return A.dropna_any(fund_features(spark, sf_dir))
