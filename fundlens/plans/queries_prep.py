"""Query registry, part 2: cleaning (C*), splits (D*), dedupe / merge / top-k (K*), key-set joins (J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import dedupe as K
from ..operators import split as D
from . import sql_snippets as S
from .registry import register
from .views import RAW_FILES_SQL, panel, raw_files, raw_reports, read_table

# Fixture parameters (FIXTURES.md §2): chosen so that every filter removes some funds at sf0.01.
C1_CUT, C2_CUT = "1998-12-31", "2000-12-31"
C2_MIN, C2_COL = 1000.0, "total_value"
C3_GAP = 30

PANEL_COLS = [("fund_cnpj", False), ("report_date", False), ("quota_value", True), ("total_value", True),
              ("net_asset_value", True), ("daily_inflow", True), ("daily_redemptions", True),
              ("num_shareholders", False)]


def _sel(cols, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" if dbl else f"{prefix}{c}" for c, dbl in cols)


PANEL_SEL = _sel(PANEL_COLS)

# ------------------------------------------------------------------ C: cleaning

_C1_SQL = f"""WITH {S.RAW_CTE},
r AS (SELECT fund_cnpj, report_date, l_orderkey, l_linenumber,
             nullif(daily_inflow, 0) AS daily_inflow, nullif(daily_redemptions, 0) AS daily_redemptions
      FROM raw_reports)
SELECT fund_cnpj, report_date, l_orderkey, l_linenumber, round(daily_inflow, 6) AS daily_inflow,
       round(daily_redemptions, 6) AS daily_redemptions
FROM r WHERE daily_inflow IS NOT NULL OR daily_redemptions IS NOT NULL"""


@register("c1_drop_empty_rows", _C1_SQL)
def c1_drop_empty_rows(spark, sf_dir):
    """C1 over raw reports where a zero flow is recorded as missing: drop rows with no flow at all."""
    r = raw_reports(spark, sf_dir).select(
        "fund_cnpj", "report_date", "l_orderkey", "l_linenumber",
        F.when(F.col("daily_inflow") != 0, F.col("daily_inflow")).alias("daily_inflow"),
        F.when(F.col("daily_redemptions") != 0, F.col("daily_redemptions")).alias("daily_redemptions"))
    return C.drop_empty_rows(r, ["daily_inflow", "daily_redemptions"])


_C2_CTE = f"""c2 AS (SELECT p.* FROM {{src}} p WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT fund_cnpj FROM {{src}} GROUP BY fund_cnpj
                 HAVING bool_or(coalesce(report_date < DATE '{C2_CUT}' AND {C2_COL} <= {C2_MIN}, false))
                     OR min(report_date) >= DATE '{C2_CUT}') b
  WHERE b.fund_cnpj = p.fund_cnpj))"""
_C3_CTE = f"""c3g AS (SELECT *, date_diff('day', lag(report_date) OVER (PARTITION BY fund_cnpj ORDER BY report_date),
                               report_date) AS _gap FROM {{src}}),
c3 AS (SELECT * EXCLUDE (_gap, _mg) FROM (SELECT *, max(_gap) OVER (PARTITION BY fund_cnpj) AS _mg FROM c3g)
       WHERE _mg IS NULL OR _mg <= {C3_GAP})"""
_C4_CTE = """c4r AS (SELECT *, lag(_ff) OVER (PARTITION BY fund_cnpj ORDER BY report_date) AS _prev FROM
          (SELECT *, last_value(quota_value IGNORE NULLS) OVER (PARTITION BY fund_cnpj ORDER BY report_date
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _ff FROM {src})),
c4x AS (SELECT * EXCLUDE (_ff, _prev), CASE WHEN _ff IS NULL OR _prev IS NULL THEN NULL
          WHEN _prev <> 0 THEN _ff / _prev - 1 WHEN _ff > 0 THEN CAST('inf' AS DOUBLE)
          WHEN _ff < 0 THEN CAST('-inf' AS DOUBLE) END AS _ret FROM c4r),
c4q AS (SELECT quantile_cont(_ret, 0.99999) AS hi, quantile_cont(_ret, 0.00001) AS lo FROM c4x WHERE _ret IS NOT NULL),
c4 AS (SELECT c4x.* EXCLUDE (_ret) FROM c4x WHERE fund_cnpj NOT IN (
          SELECT DISTINCT fund_cnpj FROM c4x, c4q WHERE _ret > hi OR _ret < lo))"""


def _panel_then(cte: str, src: str = "panel") -> str:
    return f"WITH {S.PANEL_CTE},\n{cte.format(src=src)}"


@register("c2_filter_min_shareholders", _panel_then(_C2_CTE) + f"\nSELECT {PANEL_SEL} FROM c2")
def c2_filter_min_shareholders(spark, sf_dir):
    """C2 with the fixture rule: total_value <= 1000 before 2000-12-31 (or born after it)."""
    return C.filter_min_shareholders(panel(spark, sf_dir), C2_CUT, C2_MIN, C2_COL)


@register("c2_filter_min_shareholders_aggregate", _panel_then(_C2_CTE) + f"\nSELECT {PANEL_SEL} FROM c2")
def c2_filter_min_shareholders_aggregate(spark, sf_dir):
    """C2, flags by map-side-combined groupBy + size-checked broadcast anti join (raw inputs)."""
    return C.filter_min_shareholders(panel(spark, sf_dir), C2_CUT, C2_MIN, C2_COL, method="aggregate")


@register("c3_filter_max_gap", _panel_then(_C3_CTE) + f"\nSELECT {PANEL_SEL} FROM c3")
def c3_filter_max_gap(spark, sf_dir):
    """C3 with a 30-day maximum gap."""
    return C.filter_max_gap(panel(spark, sf_dir), C3_GAP)


@register("c4_filter_extreme_returns", _panel_then(_C4_CTE) + f"\nSELECT {PANEL_SEL} FROM c4")
def c4_filter_extreme_returns(spark, sf_dir):
    """C4: exact global 0.99999 / 0.00001 return quantiles; funds outside are dropped."""
    return C.filter_extreme_returns(panel(spark, sf_dir))


_C5_SQL = f"""WITH {S.PANEL_CTE},
q AS (SELECT quantile_cont(quota_value, 0.25) AS q1, quantile_cont(quota_value, 0.75) AS q3 FROM panel)
SELECT {PANEL_SEL}, (quota_value < q1 - 1.5 * (q3 - q1)) OR (quota_value > q3 + 1.5 * (q3 - q1)) AS quota_value_is_outlier
FROM panel, q"""


@register("c5_flag_outliers", _C5_SQL)
def c5_flag_outliers(spark, sf_dir):
    """C5 configured: IQR rule (k = 1.5) on quota_value with exact global quartiles."""
    return C.flag_outliers(panel(spark, sf_dir), {"columns": ["quota_value"], "k": 1.5})


C6_CTES = (f"WITH {S.PANEL_CTE},\nc1 AS (SELECT DISTINCT * FROM panel WHERE fund_cnpj IS NOT NULL OR report_date IS NOT NULL),\n"
           + _C2_CTE.format(src="c1") + ",\n" + _C3_CTE.format(src="c2") + ",\n" + _C4_CTE.format(src="c3"))
_C6_SQL = C6_CTES + f"\nSELECT {PANEL_SEL} FROM c4"


def fixture_clean_config() -> C.CleanConfig:
    return C.CleanConfig(cutoff=C2_CUT, min_value=C2_MIN, min_value_col=C2_COL, max_gap=C3_GAP)


@register("c6_clean", _C6_SQL)
def c6_clean(spark, sf_dir):
    """Require -> C1 -> K4 -> C2 -> C3 -> C5 -> C4 with the fixture parameters."""
    return C.clean(panel(spark, sf_dir), fixture_clean_config())


# ------------------------------------------------------------------ D: splits

@register("d1_split_temporal", f"WITH {S.PANEL_CTE}\nSELECT fund_cnpj, report_date, dataset FROM ("
          + S.split_sql("panel", C1_CUT, C2_CUT) + ")")
def d1_split_temporal(spark, sf_dir):
    """D1, reference boundary: rows dated on the second cutoff are in test and validation."""
    return D.split_labeled(panel(spark, sf_dir), C2_CUT, C1_CUT).select("fund_cnpj", "report_date", "dataset")


_D1_DISJOINT = f"""WITH {S.PANEL_CTE}
SELECT fund_cnpj, report_date, CASE WHEN report_date <= DATE '{C1_CUT}' THEN 'train'
  WHEN report_date <= DATE '{C2_CUT}' THEN 'test' ELSE 'validation' END AS dataset FROM panel"""


@register("d1_split_disjoint", _D1_DISJOINT)
def d1_split_disjoint(spark, sf_dir):
    """D1, disjoint boundary: validation starts after the second cutoff."""
    return D.split_labeled(panel(spark, sf_dir), C2_CUT, C1_CUT, boundary="disjoint").select(
        "fund_cnpj", "report_date", "dataset")


_D2_H = "('0x' || substr(md5({}), 1, 13))::BIGINT"
_D2_SQL = f"""WITH {S.PANEL_CTE},
h AS (SELECT fund_cnpj, report_date, report_date >= DATE '{C2_CUT}' AS val,
             {_D2_H.format("'42|' || fund_cnpj || '|' || CAST(report_date AS VARCHAR)")} AS h1 FROM panel),
r AS (SELECT *, row_number() OVER (PARTITION BY val ORDER BY h1) AS rn, count(*) OVER (PARTITION BY val) AS n FROM h)
SELECT fund_cnpj, report_date, CASE WHEN val THEN 'validation' WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS dataset FROM r"""


@register("d2_split_random", _D2_SQL)
def d2_split_random(spark, sf_dir):
    """Validation after the cutoff; exactly ceil(20%) of the earlier rows in test (seeded hash rank)."""
    return D.split_random(panel(spark, sf_dir), C2_CUT, 0.2, 42, key_cols=["fund_cnpj", "report_date"]
                          ).select("fund_cnpj", "report_date", "dataset")


# ------------------------------------------------------------------ K: dedupe, merge, top-k

_RAW_COLS = PANEL_COLS + [("l_orderkey", False), ("l_linenumber", False)]
_RAW_ORDER = ("num_shareholders DESC NULLS LAST, quota_value DESC NULLS LAST, total_value DESC NULLS LAST, "
              "net_asset_value DESC NULLS LAST, daily_inflow DESC NULLS LAST, daily_redemptions DESC NULLS LAST, "
              "l_orderkey DESC NULLS LAST, l_linenumber DESC NULLS LAST")


@register("k1_dedupe_keep_max", f"""WITH {S.RAW_CTE}
SELECT {_sel(_RAW_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY fund_cnpj, report_date
  ORDER BY {_RAW_ORDER}) AS _rn FROM raw_reports WHERE fund_cnpj IS NOT NULL AND report_date IS NOT NULL) WHERE _rn = 1""")
def k1_dedupe_keep_max(spark, sf_dir):
    """K1 on raw reports (many rows per key, ties on the count): keep max num_shareholders."""
    return K.dedupe_keep_max(raw_reports(spark, sf_dir))


_K2_COLS = [('"CNPJ_FUNDO"', False), ('"DT_COMPTC"', False), ('"VL_QUOTA"', True), ('"ID"', False),
            ('"LINE_NO"', False)]


@register("k2_dedupe_keep_last", f"""WITH rf AS ({RAW_FILES_SQL})
SELECT {_sel(_K2_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY "CNPJ_FUNDO", "DT_COMPTC"
  ORDER BY "ID" DESC, "LINE_NO" DESC) AS _rn FROM rf) WHERE _rn = 1""")
def k2_dedupe_keep_last(spark, sf_dir):
    """K2 on source-file rows: per (CNPJ_FUNDO, DT_COMPTC) the row with the greatest (ID, LINE_NO)."""
    rf = raw_files(spark, sf_dir).select("CNPJ_FUNDO", "DT_COMPTC", "VL_QUOTA", "ID", "LINE_NO")
    return K.dedupe_keep_last(rf, ["ID", "LINE_NO"])


@register("k3_dedupe_keep_first", f"""WITH {S.RAW_CTE}
SELECT {_sel(_RAW_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY fund_cnpj, report_date
  ORDER BY l_orderkey, l_linenumber) AS _rn FROM raw_reports) WHERE _rn = 1""")
def k3_dedupe_keep_first(spark, sf_dir):
    """K3: per (fund, date) the first row in source order (l_orderkey, l_linenumber)."""
    return K.dedupe_keep_first(raw_reports(spark, sf_dir), ["l_orderkey", "l_linenumber"])


@register("k4_drop_exact_duplicates", f"""WITH {S.RAW_CTE}
SELECT DISTINCT fund_cnpj, report_date, num_shareholders FROM raw_reports""")
def k4_drop_exact_duplicates(spark, sf_dir):
    return K.drop_exact_duplicates(raw_reports(spark, sf_dir).select("fund_cnpj", "report_date",
                                                                      "num_shareholders"))


def _increment(spark, sf_dir):
    """Restated figures for Dec 1999 onwards: quota = max price of the day (differs from avg)."""
    li = read_table(spark, sf_dir, "lineitem").where(F.to_date("l_shipdate") >= F.lit("1999-12-01").cast("date"))
    p = F.col("l_extendedprice")
    return (li.groupBy(F.lpad(F.col("l_suppkey").cast("string"), 14, "0").alias("fund_cnpj"),
                       F.to_date("l_shipdate").alias("report_date"))
            .agg(F.max(p).alias("quota_value"), F.sum(p).alias("total_value"),
                 F.sum(p * (1 - F.col("l_discount"))).alias("net_asset_value"),
                 F.sum(F.when(F.col("l_returnflag") == "N", p).otherwise(0.0)).alias("daily_inflow"),
                 F.sum(F.when(F.col("l_returnflag") == "R", p).otherwise(0.0)).alias("daily_redemptions"),
                 F.countDistinct("l_orderkey").alias("num_shareholders")))


_K5_SQL = f"""WITH {S.PANEL_CTE},
e AS (SELECT * FROM panel WHERE report_date < DATE '2000-01-01'),
i AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 14, '0') AS fund_cnpj, CAST(l_shipdate AS DATE) AS report_date,
        max(l_extendedprice) AS quota_value, sum(l_extendedprice) AS total_value,
        sum(l_extendedprice * (1 - l_discount)) AS net_asset_value,
        sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END) AS daily_inflow,
        sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS daily_redemptions,
        count(DISTINCT l_orderkey) AS num_shareholders
      FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1999-12-01' GROUP BY 1, 2),
u AS (SELECT * FROM i UNION ALL SELECT * FROM e WHERE NOT EXISTS
        (SELECT 1 FROM i WHERE i.fund_cnpj = e.fund_cnpj AND i.report_date = e.report_date))
SELECT {PANEL_SEL} FROM u"""


@register("k5_upsert_increment", _K5_SQL)
def k5_upsert_increment(spark, sf_dir):
    """K5: panel before 2000 UNION restated panel from Dec 1999; the increment wins on (fund, date)."""
    existing = panel(spark, sf_dir).where(F.col("report_date") < F.lit("2000-01-01").cast("date"))
    return K.upsert(existing, _increment(spark, sf_dir))


_TODAY = "2002-03-15"


@register("k6_missing_months", f"""SELECT CAST(m AS DATE) AS month_start FROM (
  SELECT unnest(generate_series(date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH,
                                date_trunc('month', DATE '{_TODAY}') - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m
  FROM orders)""")
def k6_missing_months(spark, sf_dir):
    """K6: months after the orders high-water mark up to the last complete month before 2002-03-15."""
    return K.missing_months(read_table(spark, sf_dir, "orders"), "o_orderdate", today=_TODAY)


@register("k7_top_k_counts", f"""WITH {S.RAW_CTE}
SELECT fund_cnpj, count(*) AS count FROM raw_reports GROUP BY fund_cnpj ORDER BY count DESC, fund_cnpj LIMIT 10""")
def k7_top_k_counts(spark, sf_dir):
    """K7: the 10 funds with most raw report rows (count desc, id asc on ties)."""
    return K.top_k_counts(raw_reports(spark, sf_dir), "fund_cnpj", 10)


@register("k8_global_sort", f"WITH {S.PANEL_CTE}\nSELECT {PANEL_SEL} FROM panel ORDER BY fund_cnpj, report_date")
def k8_global_sort(spark, sf_dir):
    """K8: range-partitioned global sort by (fund, date) in front of a sink."""
    return K.sort_for_sink(panel(spark, sf_dir))


# ------------------------------------------------------------------ J: key-set joins

_RF_COLS = [('"TP_FUNDO"', False), ('"CNPJ_FUNDO"', False), ('"DT_COMPTC"', False), ('"VL_QUOTA"', True),
            ('"VL_TOTAL"', True), ('"VL_PATRIM_LIQ"', True), ('"CAPTC_DIA"', True), ('"RESG_DIA"', True),
            ('"NR_COTST"', False), ('"ID_SUBCLASSE"', False), ('"ID"', False), ('"LINE_NO"', False)]


@register("j1_semi_join_catalog", f"""WITH rf AS ({RAW_FILES_SQL})
SELECT {_sel(_RF_COLS)} FROM rf WHERE regexp_replace(trim("CNPJ_FUNDO"), '\\D', '', 'g') IN
  (SELECT regexp_replace(trim(lpad(CAST(s_suppkey AS VARCHAR), 14, '0')), '\\D', '', 'g') FROM supplier WHERE s_acctbal > 0)""")
def j1_semi_join_catalog(spark, sf_dir):
    """Source rows of funds present in the catalog (suppliers with a positive balance)."""
    cat = read_table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 0).select(
        F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("CNPJ_FUNDO"))
    return K.semi_join_catalog(raw_files(spark, sf_dir), cat)


_BAD_SQL = f"SELECT DISTINCT fund_cnpj FROM panel WHERE {C2_COL} <= {C2_MIN}"


@register("j2_anti_join_bad_funds", f"WITH {S.PANEL_CTE}\nSELECT {PANEL_SEL} FROM panel p WHERE NOT EXISTS "
          f"(SELECT 1 FROM ({_BAD_SQL}) b WHERE b.fund_cnpj = p.fund_cnpj)")
def j2_anti_join_bad_funds(spark, sf_dir):
    """Drop every row of a fund that ever reported total_value <= 1000."""
    p = panel(spark, sf_dir)
    return K.anti_join_ids(p, p.where(F.col(C2_COL) <= C2_MIN).select("fund_cnpj"))


_GAP_SQL = ("SELECT DISTINCT fund_cnpj FROM (SELECT fund_cnpj, date_diff('day', lag(report_date) OVER "
            "(PARTITION BY fund_cnpj ORDER BY report_date), report_date) AS g FROM panel) WHERE g > 30")


@register("j3_union_of_id_sets", f"WITH {S.PANEL_CTE}\n{_BAD_SQL} UNION {_GAP_SQL}")
def j3_union_of_id_sets(spark, sf_dir):
    """Funds flagged by the value rule UNION funds flagged by the gap rule."""
    p = panel(spark, sf_dir)
    low = p.where(F.col(C2_COL) <= C2_MIN).select("fund_cnpj")
    from pyspark.sql import Window

    w = Window.partitionBy("fund_cnpj").orderBy("report_date")
    gap = (p.withColumn("g", F.datediff("report_date", F.lag("report_date").over(w)))
           .where(F.col("g") > C3_GAP).select("fund_cnpj"))
    return K.union_ids(low, gap)


_J4_SQL = f"""WITH {S.PANEL_CTE},
a AS (SELECT fund_cnpj, count(*) AS n_train FROM panel WHERE report_date <= DATE '{C1_CUT}' GROUP BY 1),
b AS (SELECT fund_cnpj, count(*) AS n_validation FROM panel WHERE report_date >= DATE '{C2_CUT}' GROUP BY 1)
SELECT fund_cnpj, n_train, n_validation FROM a FULL OUTER JOIN b USING (fund_cnpj)"""


@register("j4_align_on_key", _J4_SQL)
def j4_align_on_key(spark, sf_dir):
    """Per-fund train and validation row counts aligned by a full outer join."""
    p = panel(spark, sf_dir)
    a = p.where(F.col("report_date") <= F.lit(C1_CUT).cast("date")).groupBy("fund_cnpj").agg(
        F.count(F.lit(1)).alias("n_train"))
    b = p.where(F.col("report_date") >= F.lit(C2_CUT).cast("date")).groupBy("fund_cnpj").agg(
        F.count(F.lit(1)).alias("n_validation"))
    return K.align_on_key(a, b).select("fund_cnpj", "n_train", "n_validation")


@register("j5_distinct_ids", f"WITH {S.RAW_CTE}\nSELECT DISTINCT fund_cnpj FROM raw_reports WHERE fund_cnpj IS NOT NULL")
def j5_distinct_ids(spark, sf_dir):
    return K.distinct_ids(raw_reports(spark, sf_dir))


@register("j5_count_distinct_ids", f"WITH {S.RAW_CTE}\nSELECT count(DISTINCT fund_cnpj) AS n_distinct FROM raw_reports")
def j5_count_distinct_ids(spark, sf_dir):
    return K.count_distinct_ids(raw_reports(spark, sf_dir))

