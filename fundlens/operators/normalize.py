"""Column / schema normalisation (N1-N12) and the composed X1-X3 steps.

Header decisions are driver-side metadata operations (``toDF`` / ``drop`` / renames); value work
(id cleaning, date coercion) stays in column expressions. Decisions that need data (all-NULL
columns, id cardinality) are one aggregate job each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import digits_only, snake_case
from .carry import carry

ID, DATE = "fund_cnpj", "report_date"

# fixed values: nuisance columns, synonym table and preferred order (must equal the reference's)
DENYLIST = ["tp_fundo_classe", "id_subclase", "id_subclasse", "tp_fundo", "unamed", "unnamed", "index",
            "row_id", "id"]
SYNONYMS = {
    "report_date": ["dt_comptc", "data_competencia", "data", "date", "dt"],
    "quota_value": ["vl_quota", "valor_quota", "quota", "cotacao"],
    "total_value": ["vl_total", "valor_total", "total", "montante"],
    "net_asset_value": ["vl_patrim_liq", "patrimonio_liquido", "pl", "nav"],
    "daily_inflow": ["captc_dia", "captacao_diaria", "inflow", "entrada"],
    "daily_redemptions": ["resg_dia", "resgate_diario", "redemption", "saida"],
    "num_shareholders": ["nr_cotst", "num_cotistas", "cotistas", "investidores"],
}
PREFERRED_ORDER = ["fund_cnpj", "report_date", "quota_value", "total_value", "net_asset_value",
                   "daily_inflow", "daily_redemptions", "num_shareholders"]
DATE_PATTERNS = ["report_date", "dt_comptc", "data_competencia", "date", "data"]


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Normalise every header; two headers mapping to one name is an error."""
    names = [snake_case(c) for c in df.columns]
    dup = {n for n in names if names.count(n) > 1}
    if dup:
        raise ValueError(f"headers collide after normalisation: {sorted(dup)}")
    return df.toDF(*names)


def all_null_columns(df: DataFrame) -> list[str]:
    """Columns without a single non-NULL value (one aggregate job)."""
    if not df.columns:
        return []
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"c{i}"] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that are NULL in every row."""
    return df.drop(*all_null_columns(df))


def drop_denylisted(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Drop nuisance columns (absent names are ignored)."""
    return df.drop(*[c for c in [*DENYLIST, *extra] if c in df.columns])


def rename_synonyms(df: DataFrame) -> DataFrame:
    """Canonical names; the first synonym present wins; an existing target is left alone."""
    for target, names in SYNONYMS.items():
        if target in df.columns:
            continue
        for n in names:
            if n in df.columns:
                df = df.withColumnRenamed(n, target)
                break
    return df


def find_id_column(columns: Sequence[str]) -> str | None:
    """Best id column by confidence: 'cnpj'+'fundo' (1.0) > 'cnpj' (0.8) > 'codigo'+'fundo' (0.6);
    the first column wins among equals."""
    best, score = None, 0.0
    for c in columns:
        lc = c.lower()
        s = 1.0 if ("cnpj" in lc and "fundo" in lc) else 0.8 if "cnpj" in lc else \
            0.6 if ("codigo" in lc and "fundo" in lc) else 0.0
        if s > score:
            best, score = c, s
    return best


def standardize_id(df: DataFrame, out: str = ID) -> DataFrame:
    """The best id column becomes ``out`` = its digits only (NULL -> ''); the source column is
    dropped. No candidate: unchanged."""
    src = find_id_column(df.columns)
    if src is None:
        return df
    df = df.withColumn(out, digits_only(src))
    return df.drop(src) if src != out else df


def validate_id(df: DataFrame, id_col: str = ID) -> DataFrame:
    """One row: valid flag, NULL and '' counts, and distinct values that are not 14 digits."""
    c = F.col(id_col)
    bad = F.when(c.isNotNull() & (c != "") & ~c.rlike("^[0-9]{14}$"), c)
    out = df.agg(F.count_if(c.isNull()).alias("n_null"), F.count_if(c == "").alias("n_empty"),
                 F.countDistinct(bad).alias("n_invalid_distinct"), F.countDistinct(c).alias("n_distinct"))
    return out.select(((F.col("n_null") == 0) & (F.col("n_empty") == 0) & (F.col("n_invalid_distinct") == 0))
                      .alias("valid"), "*")


SKETCH_BITS = 16
SKETCH_ERROR = 6 * 0.8326 / 2 ** (SKETCH_BITS / 2)     # six standard deviations of the sketch's estimate


def infer_id_by_cardinality(df: DataFrame, out: str = ID, ratio: float = 0.9) -> DataFrame:
    """When no id column exists, the first column whose name contains id/cod/num and whose
    distinct count exceeds ``ratio`` x rows becomes ``out``. One aggregate has a sketch of every
    candidate; a column is counted exactly only if the threshold lies within the sketch's error."""
    if out in df.columns:
        return df
    cands = [c for c in df.columns if any(p in c.lower() for p in ("id", "cod", "num"))]
    if not cands:
        return df
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), SKETCH_BITS))
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[sketch(c).alias(f"d{i}") for i, c in enumerate(cands)]).first()
    for i, c in enumerate(cands):
        n, limit = row[f"d{i}"] or 0, ratio * row["_n"]
        if n * (1 - SKETCH_ERROR) <= limit < n * (1 + SKETCH_ERROR):
            n = df.agg(F.countDistinct(F.col(f"`{c}`"))).first()[0]
        if n > limit:
            return df.withColumnRenamed(c, out)
    return df


def drop_comma_columns(df: DataFrame) -> DataFrame:
    """Drop mis-parsed combined headers (names containing ',')."""
    return df.drop(*[c for c in df.columns if "," in c])


# tried in order; a text that several fit is read by the first (month before day, as in US dates)
DATE_FORMATS = ("MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "yyyyMMdd",
                "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss")


def lenient_timestamp(c: Column) -> Column:
    """A timestamp from ISO text or one of ``DATE_FORMATS``; NULL for anything else."""
    text = F.trim(c.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d"), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def coerce_dates(df: DataFrame, as_date: bool = True) -> DataFrame:
    """Every date-like column parsed leniently (bad values -> NULL, never an error)."""
    out = df
    for c in [c for c in df.columns if any(p in c.lower() for p in DATE_PATTERNS)]:
        is_time = dict(df.dtypes)[c] in ("date", "timestamp", "timestamp_ntz")
        parsed = F.col(c) if is_time else lenient_timestamp(F.col(c))
        out = out.withColumn(c, parsed.cast("date") if as_date else parsed)
    return out


def reorder_columns(df: DataFrame) -> DataFrame:
    """Canonical columns first (in order), the rest after."""
    first = [c for c in PREFERRED_ORDER if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def require_columns(df: DataFrame, required: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Raise on a missing required column or a non-numeric one in ``numeric``."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    types = dict(df.dtypes)
    bad = [c for c in numeric if types.get(c) not in ("double", "float", "int", "bigint", "smallint")]
    if bad:
        raise TypeError(f"non-numeric columns: {bad}")
    return df


def identify_required(df: DataFrame) -> list[str]:
    """The id column if present, then the first date-like column."""
    req = [ID] if ID in df.columns else []
    dates = [c for c in df.columns if "date" in c.lower() or "data" in c.lower()]
    return req + dates[:1]


def standardize_columns(df: DataFrame) -> DataFrame:
    """N1 -> N3 (+ N2) -> N5 -> N4 (id detection runs before the synonym renames)."""
    df = snake_case_columns(df)
    df = drop_denylisted(df, extra=all_null_columns(df))
    df = standardize_id(df)
    return rename_synonyms(df)


def process_file(df: DataFrame) -> DataFrame | None:
    """Strip headers -> N2 -> X1 -> N12 check (N7 fallback when the id is missing)."""
    df = drop_all_null_columns(strip_headers(df))
    if not df.columns:
        return None
    df = standardize_columns(df)
    if ID not in df.columns:
        df = infer_id_by_cardinality(df)
    return df


def final_processing(df: DataFrame, as_date: bool = True) -> DataFrame:
    """N8 -> N9 -> N10."""
    return reorder_columns(coerce_dates(drop_comma_columns(df), as_date))


def fix_missing_id(df: DataFrame, method: str = "drop", order_cols: Sequence[str] = (), id_col: str = ID,
                   partition_cols: Sequence[str] = ()) -> DataFrame:
    """V9: ``drop`` rows with a NULL or '' id; ``fill_forward`` / ``fill_backward`` take the nearest
    id in source order (``order_cols``), within ``partition_cols`` (such as the source file) or over
    the whole table; an id that nothing precedes (follows) stays NULL. Unknown method: unchanged."""
    c = F.col(id_col)
    if method == "drop":
        return df.where(c.isNotNull() & (c != ""))
    if method in ("fill_forward", "fill_backward"):
        if not order_cols:
            raise ValueError("a fill needs order_cols, the source order")
        return carry(df.withColumn(id_col, F.when(c != "", c)), id_col, order_cols, partition_cols, method == "fill_backward")
    return df
