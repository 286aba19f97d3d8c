"""DuckDB text for the oracle side of the query registry (same semantics, written as SQL)."""

from __future__ import annotations

from .views import PANEL_SQL, RAW_REPORTS_SQL

FEATURE_NAMES_19 = """mean_return median_return std_return skew_return kurt_return max_drawdown avg_drawdown
avg_time_drawdown max_time_drawdown avg_gross_by_net avg_inflow avg_redemption avg_shareholders
mean_std_5 mean_std_10 mean_std_15 std_std_5 std_std_10 std_std_15""".split()
CORR_NAMES = ["corr_return_vol5", "corr_return_vol10", "corr_return_vol15"]
RATIO_NAMES = """sharpe sharpe_mean_std_5 sharpe_mean_std_10 sharpe_mean_std_15 ret_by_DD ret_by_max_DD
ret_by_timedd ret_by_timedd_max volatility_ratio_5_10 volatility_ratio_10_15""".split()
ALL_32 = FEATURE_NAMES_19 + CORR_NAMES + RATIO_NAMES


def daily_features_sql(src: str, by: str = "") -> str:
    """CTE chain (d1..d8) adding return, gross_by_net, vol_5/10/15, drawdown, time_in_drawdown."""
    part = f"PARTITION BY {by + ', ' if by else ''}fund_cnpj ORDER BY report_date"
    run = f"({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
d1 AS (SELECT *, last_value(quota_value IGNORE NULLS) OVER {run} AS _ff FROM {src}),
d2 AS (SELECT *, lag(_ff) OVER ({part}) AS _prev FROM d1),
d3 AS (SELECT * EXCLUDE (_ff, _prev),
   CASE WHEN _ff IS NULL OR _prev IS NULL THEN NULL WHEN _prev <> 0 THEN _ff / _prev - 1
        WHEN _ff > 0 THEN CAST('inf' AS DOUBLE) WHEN _ff < 0 THEN CAST('-inf' AS DOUBLE) END AS "return",
   CASE WHEN net_asset_value <> 0 THEN total_value / net_asset_value END AS gross_by_net
   FROM d2),
d4 AS (SELECT *, CASE WHEN isfinite("return") THEN "return" END AS _fr,
                 CASE WHEN isfinite(quota_value) THEN quota_value END AS _fq FROM d3),
d5 AS (SELECT *,
   CASE WHEN count(_fr) OVER ({part} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2
        THEN stddev_samp(_fr) OVER ({part} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS vol_5,
   CASE WHEN count(_fr) OVER ({part} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 5
        THEN stddev_samp(_fr) OVER ({part} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS vol_10,
   CASE WHEN count(_fr) OVER ({part} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) >= 7
        THEN stddev_samp(_fr) OVER ({part} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END AS vol_15,
   max(_fq) OVER {run} AS _peak
   FROM d4),
d6 AS (SELECT * EXCLUDE (_fr, _fq, _peak),
   CASE WHEN quota_value <> 0 THEN _peak / quota_value END - 1 AS drawdown FROM d5),
d7 AS (SELECT *, sum(CAST(coalesce(drawdown > 0, false) AS INTEGER)) OVER {run} AS _c FROM d6),
d8 AS (SELECT * EXCLUDE (_c, _lr), CAST(_c - coalesce(_lr, 0) AS INTEGER) AS time_in_drawdown
   FROM (SELECT *, max(CASE WHEN NOT coalesce(drawdown > 0, false) THEN _c END) OVER {run} AS _lr FROM d7))"""


def _corr_sql(w: int, strict: bool = False) -> str:
    xs = f'CASE WHEN "return" IS NOT NULL AND vol_{w} IS NOT NULL THEN "return" END'
    ys = f'CASE WHEN "return" IS NOT NULL AND vol_{w} IS NOT NULL THEN vol_{w} END'
    spread = f"var_pop({xs}) > 0 AND var_pop({ys}) > 0"
    if strict:
        cond = f"count(*) > 1 AND count({xs}) = count(*) AND {spread}"
    else:
        cond = f"count({xs}) >= 2 AND {spread}"
    return f"CASE WHEN {cond} THEN corr({xs}, {ys}) END AS corr_return_vol{w}"


def fund_aggregate_sql(src: str, by: str = "", strict_corr: bool = False) -> str:
    """CTE chain (g1..g3) over daily features: aggregates, ratios, inf -> NULL."""
    keys = f"{by + ', ' if by else ''}fund_cnpj"
    r = '"return"'
    corr = ",\n   ".join(_corr_sql(w, strict_corr) for w in (5, 10, 15))
    inf_null = ",\n   ".join(
        f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" if c != "max_time_drawdown" else c
        for c in ALL_32)
    return f"""
g1 AS (SELECT {keys},
   avg({r}) AS mean_return, median({r}) AS median_return, stddev_samp({r}) AS std_return,
   CASE WHEN count({r}) < 3 THEN NULL WHEN var_pop({r}) = 0 THEN 0 ELSE skewness({r}) END AS skew_return,
   CASE WHEN count({r}) < 4 THEN NULL WHEN var_pop({r}) = 0 THEN 0 ELSE kurtosis({r}) END AS kurt_return,
   max(drawdown) AS max_drawdown, avg(drawdown) AS avg_drawdown,
   avg(time_in_drawdown) AS avg_time_drawdown, max(time_in_drawdown) AS max_time_drawdown,
   avg(gross_by_net) AS avg_gross_by_net, avg(daily_inflow) AS avg_inflow,
   avg(daily_redemptions) AS avg_redemption, avg(num_shareholders) AS avg_shareholders,
   avg(vol_5) AS mean_std_5, avg(vol_10) AS mean_std_10, avg(vol_15) AS mean_std_15,
   stddev_samp(vol_5) AS std_std_5, stddev_samp(vol_10) AS std_std_10, stddev_samp(vol_15) AS std_std_15,
   {corr}
   FROM {src} GROUP BY {keys}),
g2 AS (SELECT *,
   CASE WHEN std_return <> 0 THEN mean_return / std_return END AS sharpe,
   CASE WHEN mean_std_5 <> 0 THEN mean_return / mean_std_5 END AS sharpe_mean_std_5,
   CASE WHEN mean_std_10 <> 0 THEN mean_return / mean_std_10 END AS sharpe_mean_std_10,
   CASE WHEN mean_std_15 <> 0 THEN mean_return / mean_std_15 END AS sharpe_mean_std_15,
   CASE WHEN abs(avg_drawdown) <> 0 THEN mean_return / abs(avg_drawdown) END AS ret_by_DD,
   CASE WHEN abs(max_drawdown) <> 0 THEN mean_return / abs(max_drawdown) END AS ret_by_max_DD,
   CASE WHEN avg_time_drawdown <> 0 THEN mean_return / avg_time_drawdown END AS ret_by_timedd,
   CASE WHEN max_time_drawdown <> 0 THEN mean_return / max_time_drawdown END AS ret_by_timedd_max,
   CASE WHEN mean_std_10 <> 0 THEN mean_std_5 / mean_std_10 END AS volatility_ratio_5_10,
   CASE WHEN mean_std_15 <> 0 THEN mean_std_10 / mean_std_15 END AS volatility_ratio_10_15
   FROM g1),
g3 AS (SELECT {keys},
   {inf_null}
   FROM g2)"""


def null_fraction_sql(cols=ALL_32) -> str:
    return "(" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in cols) + f") / {float(len(cols))}"


PANEL_CTE = f"panel AS (\n{PANEL_SQL}\n)"
RAW_CTE = f"raw_reports AS (\n{RAW_REPORTS_SQL}\n)"


def split_sql(src: str = "panel", c1: str = "1998-12-31", c2: str = "2000-12-31") -> str:
    """D1 (reference boundary): one row per (row, dataset); rows dated c2 are in test and validation."""
    return f"""
SELECT *, 'train' AS dataset FROM {src} WHERE report_date <= DATE '{c1}'
UNION ALL SELECT *, 'test' AS dataset FROM {src} WHERE report_date > DATE '{c1}' AND report_date <= DATE '{c2}'
UNION ALL SELECT *, 'validation' AS dataset FROM {src} WHERE report_date >= DATE '{c2}'"""
