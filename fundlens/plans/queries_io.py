"""Query registry, part 4: sources / sinks (S*), normalisation (N*, X1-X4) and quality reports (V*).

Source queries first write table-derived files with Spark into a fresh folder under the shared
checkpoint directory, then read them back through the source operators, so their work grows with
the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import normalize as N
from ..operators import quality as V
from ..operators.clean import null_summary
from ..operators.dedupe import semi_join_catalog
from ..session import open_writers, scratch_path
from ..sources import files as SRC
from . import sql_snippets as S
from .load import load_panel, load_raw
from .queries_prep import PANEL_SEL
from .registry import register
from .views import RAW_FILES_SQL, panel, raw_files, read_table

_WRITTEN: dict[tuple, str] = {}


def raw_csv_tree(spark, sf_dir: str) -> str:
    """The source-file rows written as ';' CSV files, one folder per year (written once per session)."""
    key = (id(spark.sparkContext), sf_dir)
    if key not in _WRITTEN:
        path = scratch_path(spark, "raw-csv")
        with open_writers(spark):
            (raw_files(spark, sf_dir).withColumn("_year", F.substring("DT_COMPTC", 1, 4))
             .write.partitionBy("_year").option("header", True).option("sep", ";").csv(path))
        _WRITTEN[key] = path
    return _WRITTEN[key]


_RF = f"rf AS ({RAW_FILES_SQL})"


@register("s1_scan_csv_tree", f"""WITH {_RF}
SELECT "CNPJ_FUNDO", "DT_COMPTC", round("VL_QUOTA", 6) AS "VL_QUOTA", "NR_COTST", "ID", "LINE_NO" FROM rf""")
def s1_scan_csv_tree(spark, sf_dir):
    """S1-S3 + S11: every CSV below the folder, header-addressed fields, back to typed columns."""
    rows, headers = SRC.scan_csv_tree(spark, raw_csv_tree(spark, sf_dir))
    cols = SRC.columns_from_fields(rows, headers)
    return cols.select("CNPJ_FUNDO", "DT_COMPTC", F.col("VL_QUOTA").cast("double").alias("VL_QUOTA"),
                       F.col("NR_COTST").cast("bigint").alias("NR_COTST"), F.col("ID").cast("bigint").alias("ID"),
                       F.col("LINE_NO").cast("int").alias("LINE_NO"))


_K1_ORDER = ("num_shareholders DESC NULLS LAST, quota_value DESC NULLS LAST, total_value DESC NULLS LAST, "
             "net_asset_value DESC NULLS LAST, daily_inflow DESC NULLS LAST, daily_redemptions DESC NULLS LAST, "
             "line_no DESC NULLS LAST")
_X4_SQL = f"""WITH {S.RAW_CTE},
r AS (SELECT fund_cnpj, report_date, quota_value, total_value, net_asset_value, daily_inflow, daily_redemptions,
        num_shareholders, l_linenumber AS line_no FROM raw_reports),
k AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY fund_cnpj, report_date
        ORDER BY {_K1_ORDER}) AS _rn FROM r) WHERE _rn = 1),
m AS (SELECT *, strftime(report_date, '%m-%Y') AS month FROM k),
a AS (SELECT *, count(fund_cnpj) OVER (PARTITION BY fund_cnpj, month) AS appearances_per_month FROM m),
x AS (SELECT *, max(appearances_per_month) OVER (PARTITION BY month) AS max_monthly_appearances FROM a)
SELECT {PANEL_SEL}, month, appearances_per_month, max_monthly_appearances FROM x"""


@register("x4_load_panel", _X4_SQL)
def x4_load_panel(spark, sf_dir):
    """CSV tree -> standardise headers/ids -> union -> dates -> K1 -> month label and counts."""
    df = load_panel(spark, raw_csv_tree(spark, sf_dir))
    return df.select("fund_cnpj", "report_date", "quota_value", "total_value", "net_asset_value", "daily_inflow",
                     "daily_redemptions", "num_shareholders", "month", "appearances_per_month",
                     "max_monthly_appearances")


_V1_SQL = f"""WITH {_RF}
SELECT 'year=' || substr("DT_COMPTC", 1, 4) AS source_file, count(*) AS total_rows,
  count(*) FILTER (WHERE "CNPJ_FUNDO" IS NULL) AS missing_fund_cnpj,
  count(*) FILTER (WHERE "DT_COMPTC" IS NULL) AS missing_report_date,
  count(*) FILTER (WHERE "CNPJ_FUNDO" IS NULL AND "DT_COMPTC" IS NULL) AS fully_empty_rows,
  count(*) FILTER (WHERE "CNPJ_FUNDO" IS NULL OR "DT_COMPTC" IS NULL) AS rows_with_any_missing_required,
  round(count(*) FILTER (WHERE "CNPJ_FUNDO" IS NULL OR "DT_COMPTC" IS NULL) / count(*) * 100.0, 6) AS missing_fraction_pct
FROM rf GROUP BY 1"""


@register("v1_source_quality_report", _V1_SQL)
def v1_source_quality_report(spark, sf_dir):
    """V1 per source folder of the loaded files (required: fund id and date)."""
    raw = load_raw(spark, raw_csv_tree(spark, sf_dir))
    src = F.regexp_extract("source_file", r"(_year=\d+)", 1)
    rep = V.source_quality_report(raw.withColumn("src", F.regexp_replace(src, "^_", "")), "src")
    return rep


@register("s8_read_catalog", f"""WITH {_RF}
SELECT "CNPJ_FUNDO", "DT_COMPTC", round("VL_QUOTA", 6) AS "VL_QUOTA", "LINE_NO" FROM rf
WHERE regexp_replace("CNPJ_FUNDO", '\\D', '', 'g') IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0')
  FROM supplier WHERE s_acctbal > 0)""")
def s8_read_catalog(spark, sf_dir):
    """S8 + J1: a Latin-1 catalog file (from suppliers with a positive balance) read as strings and
    used to keep the source rows of known funds."""
    path = scratch_path(spark, "catalog")
    sup = read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0)
    (sup.select(F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("CNPJ_FUNDO"),
                F.col("s_name").alias("DENOM_SOCIAL"), F.lit("EM FUNCIONAMENTO NORMAL").alias("SIT"),
                F.col("s_nationkey").cast("string").alias("CD_CVM"), F.lit("x").alias("EXTRA"))
     .write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path))
    cat = SRC.read_catalog(spark, path)
    rf = raw_files(spark, sf_dir).select("CNPJ_FUNDO", "DT_COMPTC", "VL_QUOTA", "LINE_NO")
    return semi_join_catalog(rf, cat)


@register("s9_pipeline_status", f"""WITH {_RF}
SELECT count(DISTINCT "CNPJ_FUNDO") AS total_funds, count(*) AS total_records,
       max(CAST("DT_COMPTC" AS DATE)) AS last_processed_date FROM rf""")
def s9_pipeline_status(spark, sf_dir):
    return SRC.pipeline_status(raw_files(spark, sf_dir))


@register("s10_parquet_roundtrip", f"WITH {S.PANEL_CTE}\nSELECT {PANEL_SEL} FROM panel")
def s10_parquet_roundtrip(spark, sf_dir):
    """The panel written as snappy parquet partitioned by year, then scanned back."""
    path = scratch_path(spark, "panel-parquet")
    SRC.write_parquet(panel(spark, sf_dir).withColumn("year", F.year("report_date")), path, ["year"])
    return SRC.read_parquet(spark, path).drop("year")


_S11_SQL = f"""WITH {S.PANEL_CTE}
SELECT fund_cnpj, report_date, round(quota_value, 6) AS quota_value, NULL::DOUBLE AS daily_inflow FROM panel
  WHERE report_date <= DATE '1998-12-31'
UNION ALL SELECT fund_cnpj, report_date, NULL::DOUBLE AS quota_value, round(daily_inflow, 6) AS daily_inflow FROM panel
  WHERE report_date > DATE '1998-12-31'"""


@register("s11_union_by_name", _S11_SQL)
def s11_union_by_name(spark, sf_dir):
    """Two differently-shaped frames unioned by column name (missing columns NULL)."""
    p = panel(spark, sf_dir)
    a = p.where(F.col("report_date") <= F.lit("1998-12-31").cast("date")).select("fund_cnpj", "report_date", "quota_value")
    b = p.where(F.col("report_date") > F.lit("1998-12-31").cast("date")).select("daily_inflow", "report_date", "fund_cnpj")
    return SRC.union_by_name([a, b])


@register("s12_write_csv_sample", f"WITH {S.PANEL_CTE}\nSELECT fund_cnpj, CAST(report_date AS VARCHAR) AS report_date, "
          "round(quota_value, 6) AS quota_value FROM panel ORDER BY fund_cnpj, report_date LIMIT 10")
def s12_write_csv_sample(spark, sf_dir):
    """The first 10 rows by (fund, date) written as a CSV sample and read back."""
    path = scratch_path(spark, "sample-csv")
    SRC.write_sample_csv(panel(spark, sf_dir).select("fund_cnpj", "report_date", "quota_value"), path, 10,
                         ["fund_cnpj", "report_date"])
    back = spark.read.option("header", True).option("sep", ";").csv(path)
    return back.select("fund_cnpj", "report_date", F.col("quota_value").cast("double").alias("quota_value"))


# ------------------------------------------------------------------ N: normalisation on source rows

_MESSY = ["TP FUNDO", "  CNPJ.FUNDO ", "DT-COMPTC", "VL QUOTA", "VL.TOTAL", "VL_PATRIM_LIQ", "CAPTC_DIA",
          "RESG_DIA", "NR-COTST", "ID_SUBCLASSE", "ID", "LINE NO"]
_SNAKE = ["tp_fundo", "cnpj_fundo", "dt_comptc", "vl_quota", "vl_total", "vl_patrim_liq", "captc_dia", "resg_dia",
          "nr_cotst", "id_subclasse", "id", "line_no"]
_RF_VALUES = ['"TP_FUNDO"', '"CNPJ_FUNDO"', '"DT_COMPTC"', 'round("VL_QUOTA", 6)', 'round("VL_TOTAL", 6)',
              'round("VL_PATRIM_LIQ", 6)', 'round("CAPTC_DIA", 6)', 'round("RESG_DIA", 6)', '"NR_COTST"',
              '"ID_SUBCLASSE"', '"ID"', '"LINE_NO"']


def messy(spark, sf_dir):
    return raw_files(spark, sf_dir).toDF(*_MESSY)


def _rf_select(keep=None, rename=None):
    rename = rename or {}
    out = []
    for s_, v in zip(_SNAKE, _RF_VALUES):
        if keep is None or s_ in keep:
            out.append(f"{v} AS {rename.get(s_, s_)}")
    return f"WITH {_RF}\nSELECT " + ", ".join(out) + " FROM rf"


@register("n1_snake_case_columns", _rf_select())
def n1_snake_case_columns(spark, sf_dir):
    """N1: '  CNPJ.FUNDO ' -> cnpj_fundo, 'LINE NO' -> line_no, ..."""
    return N.snake_case_columns(messy(spark, sf_dir))


@register("n2_drop_all_null_columns", _rf_select(keep=[c for c in _SNAKE if c != "id_subclasse"]))
def n2_drop_all_null_columns(spark, sf_dir):
    """The all-NULL ID_SUBCLASSE column goes (one aggregate job decides)."""
    return N.drop_all_null_columns(N.snake_case_columns(messy(spark, sf_dir)))


@register("n3_drop_denylisted", _rf_select(keep=[c for c in _SNAKE if c not in ("tp_fundo", "id_subclasse", "id")]))
def n3_drop_denylisted(spark, sf_dir):
    return N.drop_denylisted(N.snake_case_columns(messy(spark, sf_dir)))


_SYN = {"dt_comptc": "report_date", "vl_quota": "quota_value", "vl_total": "total_value",
        "vl_patrim_liq": "net_asset_value", "captc_dia": "daily_inflow", "resg_dia": "daily_redemptions",
        "nr_cotst": "num_shareholders"}


@register("n4_rename_synonyms", _rf_select(rename=_SYN))
def n4_rename_synonyms(spark, sf_dir):
    return N.rename_synonyms(N.snake_case_columns(messy(spark, sf_dir)))


@register("n5_standardize_id", f"""WITH {_RF}
SELECT regexp_replace(trim("CNPJ_FUNDO"), '\\D', '', 'g') AS fund_cnpj, "DT_COMPTC" AS dt_comptc, "LINE_NO" AS line_no FROM rf""")
def n5_standardize_id(spark, sf_dir):
    """The best id column (cnpj + fundo) to digits only, source column dropped."""
    df = N.standardize_id(N.snake_case_columns(messy(spark, sf_dir)))
    return df.select("fund_cnpj", "dt_comptc", "line_no")


@register("n6_validate_id", f"""WITH {_RF}, i AS (SELECT regexp_replace(trim("CNPJ_FUNDO"), '\\D', '', 'g') AS f FROM rf)
SELECT count(*) FILTER (WHERE f IS NULL) = 0 AND count(*) FILTER (WHERE f = '') = 0
         AND count(DISTINCT CASE WHEN f <> '' AND NOT regexp_full_match(f, '[0-9]{{14}}') THEN f END) = 0 AS valid,
       count(*) FILTER (WHERE f IS NULL) AS n_null, count(*) FILTER (WHERE f = '') AS n_empty,
       count(DISTINCT CASE WHEN f <> '' AND NOT regexp_full_match(f, '[0-9]{{14}}') THEN f END) AS n_invalid_distinct,
       count(DISTINCT f) AS n_distinct FROM i""")
def n6_validate_id(spark, sf_dir):
    return N.validate_id(N.standardize_id(N.snake_case_columns(messy(spark, sf_dir))))


@register("n7_infer_id_by_cardinality", "SELECT event_id AS fund_cnpj, ts, user_id, event_type, round(value, 6) AS value, "
          "props FROM events")
def n7_infer_id_by_cardinality(spark, sf_dir):
    """Events has no cnpj column; event_id (distinct > 90% of rows) becomes the id."""
    return N.infer_id_by_cardinality(read_table(spark, sf_dir, "events"))


@register("n8_drop_comma_columns", _rf_select())
def n8_drop_comma_columns(spark, sf_dir):
    """A mis-parsed combined header ('VL_QUOTA,VL_TOTAL') is dropped."""
    df = N.snake_case_columns(messy(spark, sf_dir)).withColumn("vl_quota,vl_total", F.lit("1,2"))
    return N.drop_comma_columns(df)


@register("n9_coerce_dates", f"""WITH {_RF}
SELECT "CNPJ_FUNDO" AS cnpj_fundo, TRY_CAST("DT_COMPTC" AS DATE) AS dt_comptc, "LINE_NO" AS line_no FROM rf""")
def n9_coerce_dates(spark, sf_dir):
    df = N.snake_case_columns(messy(spark, sf_dir)).select("cnpj_fundo", "dt_comptc", "line_no")
    return N.coerce_dates(df)


_X1_COLS = ["fund_cnpj", "report_date", "quota_value", "total_value", "net_asset_value", "daily_inflow",
            "daily_redemptions", "num_shareholders", "line_no"]
_X_SQL = f"""WITH {_RF}
SELECT regexp_replace(trim("CNPJ_FUNDO"), '\\D', '', 'g') AS fund_cnpj, {{date}} AS report_date,
  round("VL_QUOTA", 6) AS quota_value, round("VL_TOTAL", 6) AS total_value, round("VL_PATRIM_LIQ", 6) AS net_asset_value,
  round("CAPTC_DIA", 6) AS daily_inflow, round("RESG_DIA", 6) AS daily_redemptions, "NR_COTST" AS num_shareholders,
  "LINE_NO" AS line_no FROM rf"""


@register("n10_reorder_columns", _X_SQL.format(date='"DT_COMPTC"'))
def n10_reorder_columns(spark, sf_dir):
    """N10 after X1: canonical columns first, then the rest."""
    return N.reorder_columns(N.standardize_columns(messy(spark, sf_dir)))


@register("n11_require_columns", _X_SQL.format(date='"DT_COMPTC"'))
def n11_require_columns(spark, sf_dir):
    """N11 + N12: the required columns found (id + first date-like) must exist; rows pass through."""
    df = N.reorder_columns(N.standardize_columns(messy(spark, sf_dir)))
    req = N.identify_required(df)
    return N.require_columns(df, req, numeric=["quota_value"])


@register("x1_standardize_columns", _X_SQL.format(date='"DT_COMPTC"'))
def x1_standardize_columns(spark, sf_dir):
    return N.reorder_columns(N.standardize_columns(messy(spark, sf_dir)))


@register("x2_process_file", _X_SQL.format(date='"DT_COMPTC"'))
def x2_process_file(spark, sf_dir):
    return N.reorder_columns(N.process_file(messy(spark, sf_dir)))


@register("x3_final_processing", _X_SQL.format(date='TRY_CAST("DT_COMPTC" AS DATE)'))
def x3_final_processing(spark, sf_dir):
    return N.final_processing(N.process_file(messy(spark, sf_dir)))


# ------------------------------------------------------------------ V: quality reports on the panel

_V3_SQL = f"""WITH {S.RAW_CTE}
SELECT 10 AS columns, count(*) AS total_rows, count(DISTINCT fund_cnpj) AS unique_ids,
  count(*) FILTER (WHERE fund_cnpj IS NULL) AS null_ids, count(*) FILTER (WHERE fund_cnpj = '') AS empty_ids,
  min(report_date) AS min_date, max(report_date) AS max_date,
  round(count(*) FILTER (WHERE fund_cnpj IS NULL) / count(*) * 100, 2) AS null_id_pct,
  round(count(*) FILTER (WHERE fund_cnpj = '') / count(*) * 100, 2) AS empty_id_pct FROM raw_reports"""


@register("v3_load_stats", _V3_SQL)
def v3_load_stats(spark, sf_dir):
    from .views import raw_reports

    return V.load_stats(raw_reports(spark, sf_dir))


_PCOLS = ["fund_cnpj", "report_date", "quota_value", "total_value", "net_asset_value", "daily_inflow",
          "daily_redemptions", "num_shareholders"]
_PTYPES = ["string", "date", "double", "double", "double", "double", "double", "bigint"]


def _null_source():
    return (f"WITH {S.PANEL_CTE},\nz AS (SELECT fund_cnpj, report_date, quota_value, total_value, net_asset_value, "
            "nullif(daily_inflow, 0) AS daily_inflow, nullif(daily_redemptions, 0) AS daily_redemptions, "
            "num_shareholders FROM panel)")


def _null_panel(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.withColumn("daily_inflow", F.when(F.col("daily_inflow") != 0, F.col("daily_inflow"))) \
            .withColumn("daily_redemptions", F.when(F.col("daily_redemptions") != 0, F.col("daily_redemptions")))


@register("v4_table_profile", _null_source() + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS null_pct FROM z"
    for c, t in zip(_PCOLS, _PTYPES)))
def v4_table_profile(spark, sf_dir):
    """V4 on the panel with zero flows recorded as missing."""
    return V.table_profile(_null_panel(spark, sf_dir))


@register("v4_top_ids", f"WITH {S.PANEL_CTE}\nSELECT fund_cnpj, count(*) AS count FROM panel GROUP BY 1 "
          "ORDER BY count DESC, fund_cnpj LIMIT 10")
def v4_top_ids(spark, sf_dir):
    return V.top_ids(panel(spark, sf_dir))


@register("v5_null_summary", _null_source() + "\n" + " UNION ALL ".join(
    f"SELECT count(*) AS rows, 8 AS columns, '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM z"
    for c in _PCOLS))
def v5_null_summary(spark, sf_dir):
    return null_summary(_null_panel(spark, sf_dir))


_V6_COLS = {**dict(zip(_PCOLS[2:], _PTYPES[2:])), "return": "double", "gross_by_net": "double", "vol_5": "double", "vol_10": "double",
            "vol_15": "double", "drawdown": "double", "time_in_drawdown": "int"}
_V6_SQL = f"WITH {S.PANEL_CTE},{S.daily_features_sql('panel')}\n" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column, '{t}' AS dtype, count(x) AS non_null_count, count(*) - count(x) AS null_count,
  round((count(*) - count(x)) / count(*) * 100, 6) AS null_pct, count(DISTINCT x) AS unique_count, round(avg(x), 6) AS mean,
  round(stddev_samp(x), 6) AS std, round(CAST(min(x) AS DOUBLE), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25,
  round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(CAST(max(x) AS DOUBLE), 6) AS max,
  '{FE.FEATURE_DESCRIPTIONS.get(c, "").replace(chr(39), chr(39) * 2)}' AS description FROM (SELECT CAST("{c}" AS DOUBLE) AS x FROM d8)"""
    for c, t in _V6_COLS.items())


@register("v6_feature_summary", _V6_SQL)
def v6_feature_summary(spark, sf_dir):
    """V6: describe every numeric daily feature (exact quartiles and distinct counts; rows packed once, one shuffle)."""
    daily = FE.create_features(panel(spark, sf_dir), dedupe=False)
    return V.feature_summary(daily)


_V8_SQL = (f"WITH {S.PANEL_CTE},{S.daily_features_sql('panel')}\nSELECT fund_cnpj, count(*) AS observation_count, "
           "min(report_date) AS start_date, max(report_date) AS end_date, date_diff('day', min(report_date), "
           "max(report_date)) AS days, round(avg(\"return\"), 6) AS return_mean, round(stddev_samp(\"return\"), 6) "
           "AS return_std, round(min(\"return\"), 6) AS return_min, round(max(\"return\"), 6) AS return_max, "
           "round(max(drawdown), 6) AS max_drawdown, round(avg(drawdown), 6) AS avg_drawdown FROM d8 GROUP BY fund_cnpj")


@register("v8_fund_summary", _V8_SQL)
def v8_fund_summary(spark, sf_dir):
    return FE.fund_summary(FE.create_features(panel(spark, sf_dir), dedupe=False))


_V9_SQL = f"""WITH {S.PANEL_CTE},
c AS (SELECT s.s_suppkey, lpad(CAST(s.s_suppkey AS VARCHAR), 14, '0') AS fund_cnpj FROM supplier s WHERE s.s_acctbal > 0)
SELECT p.fund_cnpj, p.report_date FROM panel p WHERE p.fund_cnpj IN (SELECT fund_cnpj FROM c)"""


def _catalog_ids(spark, sf_dir):
    """Panel rows whose id is resolved through the catalog (unknown funds get a NULL id)."""
    p = panel(spark, sf_dir).select("fund_cnpj", "report_date")
    cat = read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(
        F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("_cid"))
    return p.join(cat, p["fund_cnpj"] == cat["_cid"], "left").select(
        F.col("_cid").alias("fund_cnpj"), "report_date")


@register("v9_fix_missing_id", _V9_SQL)
def v9_fix_missing_id(spark, sf_dir):
    """V9 (drop): rows whose catalog-resolved id is NULL or '' are removed."""
    return N.fix_missing_id(_catalog_ids(spark, sf_dir), "drop")


def _source_ids(spark, sf_dir):
    """``_catalog_ids`` beside the fund that stands in the source, which orders the rows of a date."""
    p = panel(spark, sf_dir).select(F.col("fund_cnpj").alias("source_id"), "report_date")
    cat = read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(
        F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("fund_cnpj"))
    return p.join(cat, p["source_id"] == cat["fund_cnpj"], "left").select("source_id", "report_date", "fund_cnpj")


_FILL_SQL = f"""WITH {S.PANEL_CTE},
c AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cid FROM supplier WHERE s_acctbal > 0)
SELECT p.fund_cnpj AS source_id, report_date, {{value}} OVER (ORDER BY report_date, p.fund_cnpj ROWS BETWEEN {{rows}}) AS fund_cnpj
FROM panel p LEFT JOIN c ON p.fund_cnpj = cid"""


@register("v9_fill_forward", _FILL_SQL.format(value="last_value(cid IGNORE NULLS)", rows="UNBOUNDED PRECEDING AND CURRENT ROW"))
def v9_fill_forward(spark, sf_dir):
    """V9 (forward): missing ids take the last id before them, the table being one sequence."""
    return N.fix_missing_id(_source_ids(spark, sf_dir), "fill_forward", ["report_date", "source_id"])


@register("v9_fill_backward", _FILL_SQL.format(value="first_value(cid IGNORE NULLS)", rows="CURRENT ROW AND UNBOUNDED FOLLOWING"))
def v9_fill_backward(spark, sf_dir):
    """V9 (backward): missing ids take the first id after them."""
    return N.fix_missing_id(_source_ids(spark, sf_dir), "fill_backward", ["report_date", "source_id"])


@register("v2_missing_id_report", f"""WITH {S.PANEL_CTE},
c AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cid FROM supplier WHERE s_acctbal > 0),
m AS (SELECT p.report_date FROM panel p WHERE p.fund_cnpj NOT IN (SELECT cid FROM c)),
t AS (SELECT report_date, count(*) AS count FROM m GROUP BY 1 ORDER BY count DESC, report_date LIMIT 5)
SELECT report_date, count, (SELECT count(*) FROM m) AS missing_id_rows FROM t""")
def v2_missing_id_report(spark, sf_dir):
    """V2: dates with most rows whose catalog-resolved id is missing (top 5) and the total."""
    return V.missing_id_report(_catalog_ids(spark, sf_dir))


@register("v2_missing_id_samples", f"""WITH {S.PANEL_CTE},
c AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cid FROM supplier WHERE s_acctbal > 0)
SELECT NULL::VARCHAR AS fund_cnpj, p.report_date FROM panel p WHERE p.fund_cnpj NOT IN (SELECT cid FROM c) ORDER BY 2 LIMIT 5""")
def v2_missing_id_samples(spark, sf_dir):
    """V2: the five earliest rows whose catalog-resolved id is missing."""
    return V.missing_id_samples(_catalog_ids(spark, sf_dir))


@register("v4_table_totals", f"""WITH {S.PANEL_CTE},
c AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS cid FROM supplier WHERE s_acctbal > 0)
SELECT count(*) AS rows, 2 AS columns, 'date:1,string:1' AS types, count(DISTINCT cid) AS unique_ids,
       count(*) FILTER (WHERE cid IS NULL) AS missing_ids, min(report_date) AS min_date, max(report_date) AS max_date
FROM panel LEFT JOIN c ON fund_cnpj = cid""")
def v4_table_totals(spark, sf_dir):
    """V4: totals of the panel with catalog-resolved ids."""
    return V.table_totals(_catalog_ids(spark, sf_dir))


_V10_SQL = """SELECT source, sum(n_chars) AS bytes, CASE
  WHEN sum(n_chars) < 1024 THEN printf('%.1f B', sum(n_chars))
  WHEN sum(n_chars) / 1024.0 < 1024 THEN printf('%.1f KB', sum(n_chars) / 1024.0)
  WHEN sum(n_chars) / 1048576.0 < 1024 THEN printf('%.1f MB', sum(n_chars) / 1048576.0)
  WHEN sum(n_chars) / 1073741824.0 < 1024 THEN printf('%.1f GB', sum(n_chars) / 1073741824.0)
  WHEN sum(n_chars) / 1099511627776.0 < 1024 THEN printf('%.1f TB', sum(n_chars) / 1099511627776.0)
  ELSE printf('%.1f PB', sum(n_chars) / 1125899906842624.0) END AS size_label
FROM documents GROUP BY source"""


@register("v10_format_bytes", _V10_SQL)
def v10_format_bytes(spark, sf_dir):
    """Text volume per document source as a human-readable size."""
    docs = read_table(spark, sf_dir, "documents")
    return V.size_labels(docs.groupBy("source").agg(F.sum("n_chars").alias("bytes")), "bytes")



# ------------------------------------------------------------------ S5-S7, X5: monthly ZIP archives

_QUOTA_COLS = ["CNPJ_FUNDO", "DT_COMPTC", "VL_QUOTA", "ID", "LINE_NO"]


def _write_zips(rows, root):
    """One archive per month (``_m``); from 2000 on the id header is ``CNPJ_FUNDO_CLASSE``."""
    from .fixture_files import write_monthly_zips

    months = [r[0] for r in rows.select("_m").distinct().collect()]  # calendar-bounded
    headers = {m: (["CNPJ_FUNDO_CLASSE"] + _QUOTA_COLS[1:] if m >= "200001" else _QUOTA_COLS) for m in months}
    write_monthly_zips(rows, root, "_m", ["ID", "LINE_NO"], headers, months=months)


def _quota_rows(spark, sf_dir):
    from .fixture_files import month_key

    return raw_files(spark, sf_dir).select(*_QUOTA_COLS).withColumn("_m", month_key("DT_COMPTC"))


def monthly_zip_tree(spark, sf_dir: str) -> str:
    """Source rows as one ZIP per month (``<stem>.zip`` holding ``<stem>.csv``), written by Spark.
    Plus archives that the reader must skip whole: no archive at all, a wrongly named member, a
    wrong checksum and a damaged stream, the latter two behind many good lines."""
    from .fixture_files import write_bytes, zip_bytes

    key = ("zip", id(spark.sparkContext), sf_dir)
    if key not in _WRITTEN:
        root = scratch_path(spark, "monthly-zips")
        _write_zips(_quota_rows(spark, sf_dir), root)
        body = "CNPJ_FUNDO;DT_COMPTC;VL_QUOTA\n" + "".join(f"{i};1900-02-01;{i * 7919 % 1000}\n" for i in range(40_000))
        good = {m: zip_bytes(f"daily_quotas_{m}.csv", body) for m in ("190003", "190004")}
        at = good["190003"].rindex(b"PK\x01\x02") + 16             # the checksum in the directory
        wrong = good["190003"][:at] + bytes(4) + good["190003"][at + 4:]
        half = len(good["190004"]) // 2
        damaged = good["190004"][:half] + b"\xff" * 40 + good["190004"][half + 40:]
        for month, data in (("190001", b"not a zip archive"), ("190002", zip_bytes("other_name.csv", body[:200])),
                            ("190003", wrong), ("190004", damaged)):
            write_bytes(spark, f"{root}/daily_quotas_{month}.zip", data)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def _month_of():
    return F.regexp_extract("file", r"(\d{6})\.zip$", 1)

_RF_MONTH = "substr(\"DT_COMPTC\", 1, 4) || substr(\"DT_COMPTC\", 6, 2)"


@register("s5_scan_zip_csv", f"WITH {_RF}\nSELECT {_RF_MONTH} AS month, count(*) + 1 AS n_lines FROM rf GROUP BY 1")
def s5_scan_zip_csv(spark, sf_dir):
    """Lines of the member CSV of every readable monthly archive (rejects excluded)."""
    lines = SRC.read_zip_lines(spark, monthly_zip_tree(spark, sf_dir)).where(F.col("reject").isNull())
    return lines.groupBy(_month_of().alias("month")).agg(F.count(F.lit(1)).alias("n_lines"))


@register("s6_detect_key_column", f"""WITH {_RF}
SELECT DISTINCT {_RF_MONTH} AS month, CASE WHEN {_RF_MONTH} >= '200001' THEN 'CNPJ_FUNDO_CLASSE'
  ELSE 'CNPJ_FUNDO' END AS key_column FROM rf""")
def s6_detect_key_column(spark, sf_dir):
    """Per archive, the first header name containing 'cnpj' (an expression on the header row)."""
    lines = SRC.read_zip_lines(spark, monthly_zip_tree(spark, sf_dir), head_only=True)
    return lines.where((F.col("line_no") == 0) & F.col("reject").isNull()).select(
        _month_of().alias("month"), SRC.key_column_of(F.col("line")).alias("key_column"))


@register("s7_project_quota_cols", f"""WITH {_RF}
SELECT "CNPJ_FUNDO", "DT_COMPTC", round("VL_QUOTA", 6) AS "VL_QUOTA" FROM rf""")
def s7_project_quota_cols(spark, sf_dir):
    """Id (copied to CNPJ_FUNDO from whichever key column the archive has), date, quota."""
    q = SRC.read_monthly_quotas(spark, monthly_zip_tree(spark, sf_dir))
    return q.select("CNPJ_FUNDO", "DT_COMPTC", F.col("VL_QUOTA").cast("double").alias("VL_QUOTA"))


@register("x5_ingest_initial", f"""WITH {_RF},
k AS (SELECT *, row_number() OVER (PARTITION BY "CNPJ_FUNDO", "DT_COMPTC" ORDER BY "ID" DESC, "LINE_NO" DESC) AS _rn
      FROM rf WHERE regexp_replace("CNPJ_FUNDO", '\\D', '', 'g') IN
        (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') FROM supplier WHERE s_acctbal > 0))
SELECT "CNPJ_FUNDO", CAST("DT_COMPTC" AS DATE) AS "DT_COMPTC", round("VL_QUOTA", 6) AS "VL_QUOTA" FROM k WHERE _rn = 1""")
def x5_ingest_initial(spark, sf_dir):
    """Monthly ZIPs -> key/date/quota -> catalog semi join -> latest (file, line) per key."""
    from .load import ingest

    cat = read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(
        F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("CNPJ_FUNDO"))
    out = ingest(spark, monthly_zip_tree(spark, sf_dir), cat)
    return out.select("CNPJ_FUNDO", "DT_COMPTC", F.col("VL_QUOTA").cast("double").alias("VL_QUOTA"))


_RESTATED = "199506"  # fixture rule: the second increment restates this month with doubled quotas


@register("x6_ingest_update", f"""WITH {_RF},
k AS (SELECT *, row_number() OVER (PARTITION BY "CNPJ_FUNDO", "DT_COMPTC" ORDER BY "ID" DESC, "LINE_NO" DESC) AS _rn
      FROM rf WHERE regexp_replace("CNPJ_FUNDO", '\\D', '', 'g') IN
        (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') FROM supplier WHERE s_acctbal > 0)),
t AS (SELECT regexp_replace("CNPJ_FUNDO", '\\D', '', 'g') AS fund_cnpj, CAST("DT_COMPTC" AS DATE) AS report_date,
             round(CASE WHEN {_RF_MONTH} = '{_RESTATED}' THEN 2 * "VL_QUOTA" ELSE "VL_QUOTA" END, 6) AS quota_value,
             {_RF_MONTH} >= '200001' AS is_new FROM k WHERE _rn = 1)
SELECT fund_cnpj, report_date, quota_value, (SELECT count(*) FROM t) AS total_records,
       (SELECT count(*) FROM t WHERE is_new) AS new_records_count FROM t""")
def x6_ingest_update(spark, sf_dir):
    """Two increments of monthly archives, the second restating a month already stored; the table
    after both, with the second run's status."""
    from ..sources.month_table import read_table as read_month_table
    from ..streaming.increments import ingest_update

    rows = _quota_rows(spark, sf_dir)
    cat = read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(
        F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("CNPJ_FUNDO"))
    landing, stored = scratch_path(spark, "landing"), scratch_path(spark, "quotas")
    _write_zips(rows.where(F.col("_m") < "200001"), f"{landing}/first")
    ingest_update(spark, landing, stored, cat)
    again = rows.where(F.col("_m") == _RESTATED).withColumn("VL_QUOTA", F.col("VL_QUOTA") * 2)
    _write_zips(rows.where(F.col("_m") >= "200001").unionByName(again), f"{landing}/second")
    status = ingest_update(spark, landing, stored, cat).first()
    return read_month_table(spark, stored).select(
        "fund_cnpj", "report_date", "quota_value", F.lit(status["total_records"]).alias("total_records"),
        F.lit(status["new_records_count"]).alias("new_records_count"))


@register("v3_load_files", f"""WITH {_RF}
SELECT count(DISTINCT substr("DT_COMPTC", 1, 4)) + 1 AS files_found, count(DISTINCT substr("DT_COMPTC", 1, 4)) AS files_read,
       1 AS files_failed, count(*) AS data_lines FROM rf""")
def v3_load_files(spark, sf_dir):
    """V3: files found, read and failed of a tree with one file per year and one that cannot be read."""
    from .fixture_files import write_bytes

    root = scratch_path(spark, "yearly-csv")
    with open_writers(spark):
        (raw_files(spark, sf_dir).withColumn("_year", F.substring("DT_COMPTC", 1, 4)).repartition("_year")
         .write.partitionBy("_year").option("header", True).option("sep", ";").csv(root))
    write_bytes(spark, f"{root}/broken.csv.gz", b"not a gzip file")
    return SRC.file_report(spark, root)


# ------------------------------------------------------------------ S2, S3: charset and bad lines

_ACCENTED = ("aeiou", "áéíóú")  # fixture rule: vowels of supplier names accented (Latin-1 representable)


def _named_rows(spark, sf_dir):
    """Source rows with a fund name: the supplier's name with accented vowels."""
    sup = read_table(spark, sf_dir, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("_fid"),
        F.translate("s_name", *_ACCENTED).alias("DENOM_SOCIAL"))
    rf = raw_files(spark, sf_dir).withColumn("_fid", F.regexp_replace("CNPJ_FUNDO", r"\D", ""))
    return rf.join(sup, "_fid").drop("_fid")


def charset_tree(spark, sf_dir: str) -> str:
    """Years before 1998 written as ISO-8859-1 CSV, the rest as UTF-8 (one folder per year)."""
    key = ("charset", id(spark.sparkContext), sf_dir)
    if key not in _WRITTEN:
        root = scratch_path(spark, "charset-csv")
        rows = _named_rows(spark, sf_dir).select("CNPJ_FUNDO", "DT_COMPTC", "DENOM_SOCIAL", "LINE_NO", "ID") \
            .withColumn("_year", F.substring("DT_COMPTC", 1, 4))
        for enc, cond in (("ISO-8859-1", F.col("_year") < "1998"), ("UTF-8", F.col("_year") >= "1998")):
            (rows.where(cond).write.partitionBy("_year").option("header", True).option("sep", ";")
             .option("encoding", enc).csv(f"{root}/{enc.lower()}"))
        _WRITTEN[key] = root
    return _WRITTEN[key]


@register("s2_encoding_fallback", f"""WITH {_RF},
s AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS fid, translate(s_name, 'aeiou', 'áéíóú') AS denom FROM supplier)
SELECT "CNPJ_FUNDO", "DT_COMPTC", denom AS "DENOM_SOCIAL", "LINE_NO", "ID" FROM rf
JOIN s ON regexp_replace("CNPJ_FUNDO", '\\D', '', 'g') = s.fid""")
def s2_encoding_fallback(spark, sf_dir):
    """A tree mixing Latin-1 and UTF-8 files; each file is decoded with its own charset."""
    rows, headers = SRC.scan_csv_tree(spark, charset_tree(spark, sf_dir))
    cols = SRC.columns_from_fields(rows, headers)
    return cols.select("CNPJ_FUNDO", "DT_COMPTC", "DENOM_SOCIAL", F.col("LINE_NO").cast("int").alias("LINE_NO"),
                       F.col("ID").cast("bigint").alias("ID"))


def ragged_tree(spark, sf_dir: str) -> str:
    """Text files with a header line per year; a row with redemptions carries one extra field,
    a row with neither inflow nor redemption lacks its last field."""
    key = ("ragged", id(spark.sparkContext), sf_dir)
    if key not in _WRITTEN:
        root = scratch_path(spark, "ragged-csv")
        cols = ["CNPJ_FUNDO", "DT_COMPTC", "VL_QUOTA", "CAPTC_DIA", "RESG_DIA", "ID", "LINE_NO"]
        rf = raw_files(spark, sf_dir)
        full = F.concat_ws(";", *[F.col(c).cast("string") for c in cols])
        short = F.concat_ws(";", *[F.col(c).cast("string") for c in cols[:-1]])
        line = (F.when(F.col("RESG_DIA") > 0, F.concat(full, F.lit(";extra")))
                .when((F.col("CAPTC_DIA") == 0) & (F.col("RESG_DIA") == 0), short).otherwise(full))
        body = rf.select(F.substring("DT_COMPTC", 1, 4).alias("_year"), F.lit(1).alias("_o"), line.alias("value"))
        heads = body.select("_year").distinct().select("_year", F.lit(0).alias("_o"), F.lit(";".join(cols)).alias("value"))
        (heads.unionByName(body).repartition("_year").sortWithinPartitions("_year", "_o")
         .select("_year", "value").write.partitionBy("_year").text(root))
        _WRITTEN[key] = root
    return _WRITTEN[key]


@register("s3_skip_bad_lines", f"""WITH {_RF}
SELECT "CNPJ_FUNDO", "DT_COMPTC", round("VL_QUOTA", 6) AS "VL_QUOTA", "ID",
  CASE WHEN "CAPTC_DIA" = 0 AND "RESG_DIA" = 0 THEN NULL ELSE "LINE_NO" END AS "LINE_NO"
FROM rf WHERE NOT "RESG_DIA" > 0""")
def s3_skip_bad_lines(spark, sf_dir):
    """S3: over-long lines are dropped, short lines are kept with the missing field NULL."""
    rows, headers = SRC.scan_csv_tree(spark, ragged_tree(spark, sf_dir), glob="*.txt")
    cols = SRC.columns_from_fields(rows, headers)
    return cols.select("CNPJ_FUNDO", "DT_COMPTC", F.col("VL_QUOTA").cast("double").alias("VL_QUOTA"),
                       F.col("ID").cast("bigint").alias("ID"), F.col("LINE_NO").cast("int").alias("LINE_NO"))


# ------------------------------------------------------------------ S1 with line breaks in fields, S4


def broken_line_tree(spark, sf_dir: str) -> str:
    """One file per year whose fund names hold what must be quoted: line breaks, separators and doubled
    quotes, by the line number's remainder; every fifth name stays plain."""
    key = ("breaks", id(spark.sparkContext), sf_dir)
    if key not in _WRITTEN:
        root = scratch_path(spark, "broken-lines")
        rows = _named_rows(spark, sf_dir).withColumn("_year", F.substring("DT_COMPTC", 1, 4))
        kind, name = F.pmod(F.col("ID") + F.col("LINE_NO"), F.lit(5)), F.col("DENOM_SOCIAL")
        text = (F.when(kind == 0, F.concat(name, F.lit("\nfund; no"))).when(kind == 1, F.concat(F.lit('"'), name, F.lit('"\n\n"two"')))
                .when(kind == 2, F.concat(F.lit("a;"), name)).when(kind == 3, F.concat(name, F.lit(' 5" x\n'))).otherwise(name))
        with open_writers(spark):
            (rows.select("ID", text.alias("DENOM_SOCIAL"), "LINE_NO", "DT_COMPTC", "_year").repartition("_year")
             .write.partitionBy("_year").option("header", True).option("sep", ";").option("escape", '"')
             .option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(root))
        _WRITTEN[key] = root
    return _WRITTEN[key]


_NAMED_SQL = f"""{_RF},
s AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS fid, translate(s_name, 'aeiou', 'áéíóú') AS denom FROM supplier),
named AS (SELECT rf.*, denom FROM rf JOIN s ON regexp_replace("CNPJ_FUNDO", '\\D', '', 'g') = s.fid)"""


@register("s1_quoted_line_breaks", f"""WITH {_NAMED_SQL}
SELECT "ID", "LINE_NO", "DT_COMPTC", CASE ("ID" + "LINE_NO") % 5 WHEN 0 THEN denom || chr(10) || 'fund; no'
  WHEN 1 THEN '"' || denom || '"' || chr(10) || chr(10) || '"two"' WHEN 2 THEN 'a;' || denom
  WHEN 3 THEN denom || ' 5" x' || chr(10) ELSE denom END AS "DENOM_SOCIAL" FROM named""")
def s1_quoted_line_breaks(spark, sf_dir):
    """S1 on files whose records reach over lines: line breaks, separators and doubled quotes inside
    fields, whatever split a record begins in."""
    rows, headers = SRC.scan_csv_tree(spark, broken_line_tree(spark, sf_dir))
    cols = SRC.columns_from_fields(rows, headers)
    return cols.select(F.col("ID").cast("bigint").alias("ID"), F.col("LINE_NO").cast("int").alias("LINE_NO"), "DT_COMPTC", "DENOM_SOCIAL")


def yearly_tree(spark, sf_dir: str) -> str:
    """One plain file per year: id, date, name, line number."""
    key = ("yearly", id(spark.sparkContext), sf_dir)
    if key not in _WRITTEN:
        root = scratch_path(spark, "yearly-names")
        rows = _named_rows(spark, sf_dir).withColumn("_year", F.substring("DT_COMPTC", 1, 4))
        with open_writers(spark):
            (rows.select("ID", "LINE_NO", "DT_COMPTC", "DENOM_SOCIAL", "_year").repartition("_year")
             .write.partitionBy("_year").option("header", True).option("sep", ";").csv(root))
        _WRITTEN[key] = root
    return _WRITTEN[key]


@register("s4_sample_per_file", f"""WITH {_NAMED_SQL},
f AS (SELECT *, count(*) OVER (PARTITION BY substr("DT_COMPTC", 1, 4)) AS n,
  ('0x' || substr(md5('42|' || "ID" || '|' || "LINE_NO" || '|' || "DT_COMPTC" || '|' || denom), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM named)
SELECT "ID", "LINE_NO", "DT_COMPTC", denom AS "DENOM_SOCIAL" FROM f WHERE n <= 100 OR u < 100 / n""")
def s4_sample_per_file(spark, sf_dir):
    """About 100 seeded random rows of every file, drawn by the md5 of the row."""
    rows, headers = SRC.scan_csv_tree(spark, yearly_tree(spark, sf_dir), sample_size=100, seed=42)
    cols = SRC.columns_from_fields(rows, headers)
    return cols.select(F.col("ID").cast("bigint").alias("ID"), F.col("LINE_NO").cast("int").alias("LINE_NO"), "DT_COMPTC", "DENOM_SOCIAL")
