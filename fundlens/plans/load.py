"""E1/E2 loading plans: X4 ``load_panel`` (CSV tree -> canonical panel) and X5/X6 ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import digits_only, nan_to_null, snake_case
from ..operators.dedupe import dedupe_keep_max, dedupe_keep_last, semi_join_catalog
from ..operators.features import add_month_label, add_monthly_appearances
from ..operators.normalize import (DENYLIST, SYNONYMS, all_null_columns, find_id_column,
                                   final_processing)
from ..session import write_table
from ..sources.files import header_names, parsed_records, read_monthly_quotas, scan_csv_tree, scan_lines, text_or_null

NUMERIC = {"quota_value": "double", "total_value": "double", "net_asset_value": "double",
           "daily_inflow": "double", "daily_redemptions": "double", "num_shareholders": "bigint"}


def header_mapping(header: str, sep: str = ";") -> dict[str, str]:
    """X1 on header names only: canonical name -> raw name for one header."""
    raws = header_names(header, sep)
    snake = {snake_case(c): c for c in raws}
    names = [n for n in snake if n not in DENYLIST]
    out: dict[str, str] = {}
    idc = find_id_column(names)
    if idc is not None:
        out["fund_cnpj"] = snake[idc]
        names.remove(idc)
    for target, syns in SYNONYMS.items():
        if target in names:
            out[target] = snake[target]
            names.remove(target)
            continue
        for s_ in syns:
            if s_ in names:
                out[target] = snake[s_]
                names.remove(s_)
                break
    for n in names:
        out.setdefault(n, snake[n])
    return out


def load_raw(spark: SparkSession, root: str, sep: str = ";", sample_size: int | None = None,
             seed: int = 42) -> DataFrame:
    """S1-S4 -> X2 -> S11 -> X3: canonical, typed rows with their source ``file``."""
    if sample_size:
        rows, headers = scan_csv_tree(spark, root, sep, sample_size, seed)
        field = lambda j, name: F.col("fields").getItem(name)
    else:
        lines, headers = scan_lines(spark, root, sep)
        rows, names = parsed_records(lines, headers, sep), [header_names(h, sep) for h in headers]
        field = lambda j, name: text_or_null(F.col(f"r{j}.c{names[j].index(name)}"))
    maps = {h: header_mapping(h, sep) for h in headers}
    canon: list[str] = []
    for m in maps.values():
        canon += [c for c in m if c not in canon]
    cols = []
    for c in canon:
        e = None
        for j, (h, m) in enumerate(maps.items()):
            if c in m:
                v = field(j, m[c])
                e = F.when(F.col("header") == h, v) if e is None else e.when(F.col("header") == h, v)
        v = e
        if c == "fund_cnpj":
            v = digits_only(v)
        elif c in NUMERIC:
            v = nan_to_null(F.trim(v).try_cast("double"))
            v = v.try_cast("bigint") if NUMERIC[c] == "bigint" else v
        cols.append(v.alias(c))
    df = rows.select(F.col("file").alias("source_file"), *cols)
    # the records are parsed once: N2 and whatever reads the result scan the written typed rows
    df = write_table(df, "typed-rows")
    # N2 over the union, one aggregate over the typed rows that survive S3; the id is never NULL after N5
    empty = [c for c in all_null_columns(df) if c not in ("source_file", "fund_cnpj")]
    df = df.drop(*empty)
    return final_processing(df)


def load_panel(spark: SparkSession, root: str, sep: str = ";", sample_size: int | None = None,
               seed: int = 42) -> DataFrame:
    """load_raw -> K1 (max shareholders per fund/date) -> F8 -> F9 -> F10."""
    raw = load_raw(spark, root, sep, sample_size, seed).drop("source_file")
    deduped = write_table(dedupe_keep_max(raw), "deduped-rows")     # read for the rows and for the months
    return add_monthly_appearances(add_month_label(deduped))


def ingest(spark: SparkSession, zip_root: str, catalog: DataFrame, catalog_id_col: str = "CNPJ_FUNDO") -> DataFrame:
    """Monthly ZIPs -> key/date/quota projection -> catalog semi join -> keep the row of the
    latest (file, line) per (id, date). One lazy plan; one shuffle for the dedupe."""
    q = read_monthly_quotas(spark, zip_root)
    q = semi_join_catalog(q, catalog, "CNPJ_FUNDO", catalog_id_col)
    q = q.withColumn("DT_COMPTC", F.to_date(F.try_to_timestamp("DT_COMPTC")))
    return dedupe_keep_last(q, ["file", "line_no"])
