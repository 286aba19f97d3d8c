"""Data-quality and profiling reports (V1-V4, V6, V10; V5 in clean, V7/V8 in features, V9 in
normalize). Every report is one aggregate pass (plus a top-k where asked), never a driver loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import format_bytes
from .dedupe import top_k_counts
from .features import FEATURE_DESCRIPTIONS
from .profiles import column_profiles

ID, DATE = "fund_cnpj", "report_date"


def source_quality_report(df: DataFrame, source_col: str, required: Sequence[str] = (ID, DATE)) -> DataFrame:
    """V1: per source: total_rows, missing_<c>, fully_empty_rows, rows_with_any_missing_required and
    missing_fraction_pct (0 for an empty source)."""
    req = list(required)
    any_missing = F.lit(False)
    all_missing = F.lit(True)
    for c in req:
        any_missing = any_missing | F.col(c).isNull()
        all_missing = all_missing & F.col(c).isNull()
    out = df.groupBy(F.col(source_col).alias("source_file")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in req],
        F.count_if(all_missing).alias("fully_empty_rows"),
        F.count_if(any_missing).alias("rows_with_any_missing_required"))
    pct = F.when(F.col("total_rows") > 0,
                 F.col("rows_with_any_missing_required") / F.col("total_rows") * 100.0).otherwise(0.0)
    return out.withColumn("missing_fraction_pct", pct)


def missing_id_report(df: DataFrame, id_col: str = ID, date_col: str = DATE, k: int = 5) -> DataFrame:
    """V2: dates with most rows whose id is NULL or '' (top ``k``), with the total count."""
    miss = F.col(id_col).isNull() | (F.col(id_col) == "")
    top = top_k_counts(df, date_col, k, where=miss)
    total = df.agg(F.count_if(miss)).first()[0]  # one fitted scalar
    return top.withColumn("missing_id_rows", F.lit(total).cast("long"))


def missing_id_samples(df: DataFrame, id_col: str = ID, date_col: str = DATE, k: int = 5) -> DataFrame:
    """V2 sample: the first ``k`` rows without an id by date, then by the other columns (top-k)."""
    rest = [c for c in df.columns if c not in (id_col, date_col)]
    return df.where(F.col(id_col).isNull() | (F.col(id_col) == "")).orderBy(date_col, *rest).limit(k)


def load_stats(df: DataFrame, id_col: str = ID, date_col: str = DATE) -> DataFrame:
    """V3: rows, columns, unique ids, NULL and '' id counts with percentages, date range."""
    c = F.col(id_col)
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct(c).alias("unique_ids"),
                 F.count_if(c.isNull()).alias("null_ids"), F.count_if(c == "").alias("empty_ids"),
                 F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))
    n = F.col("total_rows")
    return out.select(F.lit(len(df.columns)).alias("columns"), "*",
                      F.round(F.when(n > 0, F.col("null_ids") / n * 100), 2).alias("null_id_pct"),
                      F.round(F.when(n > 0, F.col("empty_ids") / n * 100), 2).alias("empty_id_pct"))


def table_profile(df: DataFrame) -> DataFrame:
    """V4: per column its type, NULL count and NULL percentage (2 dp), from one pass + unpivot."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    types = dict(df.dtypes)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                                         F.col(f"n{i}").alias("nulls")) for i, c in enumerate(cols)]))
    return agg.select("_rows", stack.alias("_s")).select(
        "_s.column", "_s.dtype", "_s.nulls",
        F.round(F.when(F.col("_rows") > 0, F.col("_s.nulls") / F.col("_rows") * 100), 2).alias("null_pct"))


def table_totals(df: DataFrame, id_col: str = ID, date_col: str = DATE) -> DataFrame:
    """V4 totals: rows, columns, how many columns have each type (``type:n`` by name), distinct and
    missing ids, date range."""
    kinds = [t for _, t in df.dtypes]
    histogram = ",".join(f"{t}:{kinds.count(t)}" for t in sorted(set(kinds)))
    missing = F.col(id_col).isNull() | (F.col(id_col) == "")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(kinds)).alias("columns"), F.lit(histogram).alias("types"),
                  F.countDistinct(F.when(~missing, F.col(id_col))).alias("unique_ids"), F.count_if(missing).alias("missing_ids"),
                  F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))


def top_ids(df: DataFrame, id_col: str = ID, k: int = 10) -> DataFrame:
    """V4 companion: the ``k`` ids with most rows."""
    return top_k_counts(df, id_col, k)


NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def feature_summary(df: DataFrame, descriptions: dict[str, str] = FEATURE_DESCRIPTIONS) -> DataFrame:
    """V6: per numeric column: dtype, counts, NULL %, distinct count, mean, std, min, exact
    quartiles, max and description; ordered by NULL % (ties by column name)."""
    types = dict(df.dtypes)
    cols = [c for c in df.columns if types[c] in NUMERIC]
    rows = []
    # the features are computed once: the table is packed by columns, and all else reads what was packed
    for c, p in zip(cols, column_profiles(df, cols, [0.25, 0.5, 0.75]), strict=True):
        n, nn = p["rows"], p["n"]
        rows.append((c, types[c], nn, n - nn, (n - nn) / n * 100 if n else None, p["unique"], p["mean"], p["std"],
                     p["min"], *p["quantiles"], p["max"], descriptions.get(c, "")))
    schema = ("column string, dtype string, non_null_count long, null_count long, null_pct double, "
              "unique_count long, mean double, std double, min double, p25 double, p50 double, p75 double, "
              "max double, description string")
    return df.sparkSession.createDataFrame(rows, schema).orderBy("null_pct", "column")


def size_labels(df: DataFrame, size_col: str, out: str = "size_label") -> DataFrame:
    """Human-readable byte sizes (1 dp, 1024 steps)."""
    return df.withColumn(out, format_bytes(size_col))
