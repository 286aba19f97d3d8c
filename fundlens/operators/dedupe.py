"""Dedupe, incremental merge, top-k (K1-K8) and key-set joins.

Keeping one row per key is an aggregate, not a ``row_number`` window: ``max(struct(order...,
payload...))`` is combined map-side, so a key holding a third of all rows is reduced inside every
map task before the shuffle instead of being sorted in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import digits_only

ID, DATE = "fund_cnpj", "report_date"
BROADCAST_MAX_ROWS = 2_000_000


def keep_extreme_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                         largest: bool = True, descending: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the row with the largest (or smallest) ``order_cols`` tuple.

    Remaining columns break ties, so the choice is deterministic. NULL orders lowest, i.e.
    ``largest`` gives "desc nulls last" and ``not largest`` gives "asc nulls first".
    Columns in ``descending`` are compared in reverse (their negation) — numeric only.
    """
    keys = list(keys)
    payload = [c for c in df.columns if c not in keys]
    ordered = [c for c in order_cols if c in payload] + [c for c in payload if c not in order_cols]
    fields = [(-F.col(c) if c in descending else F.col(c)).alias(f"o{i}") for i, c in enumerate(ordered)]
    extra = [F.col(c).alias(f"p{i}") for i, c in enumerate(ordered) if c in descending]
    pick = F.max(F.struct(*fields, *extra)) if largest else F.min(F.struct(*fields, *extra))
    out = df.groupBy(*keys).agg(pick.alias("_r"))
    by_name = {c: F.col(f"_r.{'p' if c in descending else 'o'}{i}").alias(c) for i, c in enumerate(ordered)}
    return out.select(*[F.col(c) if c in keys else by_name[c] for c in df.columns])


def dedupe_keep_max(df: DataFrame, value_col: str = "num_shareholders",
                    tie_breakers: Sequence[str] | None = None, *, id_col: str = ID,
                    date_col: str = DATE) -> DataFrame:
    """K1: one row per (fund, date) with the maximum ``value_col``; rows with a NULL key are
    dropped (they form no group); an all-NULL group keeps one row; ties go to the largest
    ``tie_breakers`` (default: the other columns in schema order)."""
    rest = [c for c in df.columns if c not in (id_col, date_col, value_col)]
    order = [value_col] + (list(tie_breakers) if tie_breakers is not None else rest)
    keyed = df.where(F.col(id_col).isNotNull() & F.col(date_col).isNotNull())
    return keep_extreme_per_key(keyed, [id_col, date_col], order, largest=True)


def dedupe_keep_last(df: DataFrame, seq_cols: Sequence[str], *, keys: Sequence[str] = ("CNPJ_FUNDO", "DT_COMPTC")
                     ) -> DataFrame:
    """K2: consolidate files: per key keep the row with the greatest sequence (file month, file
    name, line number) — "the later file wins" made deterministic."""
    return keep_extreme_per_key(df, keys, seq_cols, largest=True)


def dedupe_keep_first(df: DataFrame, order_cols: Sequence[str], *, keys: Sequence[str] = (ID, DATE)
                      ) -> DataFrame:
    """K3: per key keep the first row in an explicit input order (smallest ``order_cols``)."""
    return keep_extreme_per_key(df, keys, order_cols, largest=False)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """K4: whole-row distinct (NULL equals NULL)."""
    return df.dropDuplicates()


def upsert(existing: DataFrame, increment: DataFrame, keys: Sequence[str] = (ID, DATE)) -> DataFrame:
    """K5: existing UNION increment, the increment wins on a key collision."""
    cols = existing.columns
    a = existing.select(*cols, F.lit(0).alias("_prio"))
    b = increment.select(*cols, F.lit(1).alias("_prio"))
    merged = keep_extreme_per_key(a.unionByName(b), keys, ["_prio"], largest=True)
    return merged.drop("_prio")


def upsert_partitions(spark, path: str, increment: DataFrame, keys: Sequence[str] = (ID, DATE),
                      partition_col: str = "month") -> None:
    """K5 sink: rewrite only the partitions the increment touches (dynamic overwrite). A table that
    does not exist yet is created, its increment reduced to one row per key like any other; every
    other failure to read the table is raised and leaves it as it was."""
    from pyspark.errors import AnalysisException

    from ..session import cut_lineage

    try:
        existing = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = increment.limit(0)
    touched = increment.select(partition_col).distinct()
    existing = existing.join(touched, on=partition_col, how="left_semi")
    # reliable checkpoint: the merge must not re-read partitions it is about to overwrite
    out = cut_lineage(upsert(existing.select(*increment.columns), increment, keys))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(path)


def missing_months(df: DataFrame, date_col: str, today: str | None = None,
                   include_current_month: bool = False) -> DataFrame:
    """K6: months to fetch after the high-water mark: first of the month after ``max(date)`` up to
    the last complete month (or the current month), inclusive; empty when up to date."""
    now = F.to_date(F.lit(today)) if today else F.current_date()
    end = F.trunc(now, "month") if include_current_month else F.add_months(F.trunc(now, "month"), -1)
    hw = df.agg(F.max(F.col(date_col).cast("date")).alias("_hw"))
    start = F.add_months(F.trunc(F.col("_hw"), "month"), 1)
    return (hw.select(start.alias("_s"), end.alias("_e"))
            .where(F.col("_s") <= F.col("_e"))
            .select(F.explode(F.sequence(F.col("_s"), F.col("_e"), F.expr("INTERVAL 1 MONTH")))
                    .alias("month_start")))


def top_k_counts(df: DataFrame, key: str, k: int, where=None) -> DataFrame:
    """K7: the ``k`` most frequent values of ``key`` (count desc, then key asc for ties)."""
    src = df if where is None else df.where(where)
    return (src.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(key).asc_nulls_last()).limit(k))


def sort_for_sink(df: DataFrame, *, id_col: str = ID, date_col: str = DATE) -> DataFrame:
    """K8: a global (range-partitioned) sort, used only in front of a sink."""
    return df.orderBy(id_col, date_col)


# ---------------------------------------------------------------- joins on key sets


def size_checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``small`` only if a bounded count proves it has at most ``max_rows`` rows;
    otherwise return it unchanged so the join shuffles (AQE may still demote it at runtime)."""
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


def semi_join_catalog(df: DataFrame, catalog: DataFrame, id_col: str = "CNPJ_FUNDO",
                      catalog_id_col: str = "CNPJ_FUNDO", normalize: bool = True) -> DataFrame:
    """Keep rows whose id is among the catalog's distinct ids (ids normalised on both sides)."""
    norm = digits_only if normalize else (lambda c: F.col(c))
    ids = catalog.select(norm(catalog_id_col).alias("_cat_id")).distinct()
    keyed = df.withColumn("_cat_id", norm(id_col))
    return keyed.join(size_checked_broadcast(ids), on="_cat_id", how="left_semi").drop("_cat_id")


def anti_join_ids(df: DataFrame, bad_ids: DataFrame, id_col: str = ID) -> DataFrame:
    """Drop all rows of the flagged ids; a NULL id never matches and is kept."""
    return df.join(bad_ids.select(id_col).distinct(), on=id_col, how="left_anti")


def union_ids(a: DataFrame, b: DataFrame, id_col: str = ID) -> DataFrame:
    """Set union of two id sets."""
    return a.select(id_col).union(b.select(id_col)).distinct()


def align_on_key(a: DataFrame, b: DataFrame, key: str = ID) -> DataFrame:
    """Column-wise alignment of two keyed tables (full outer join on the key)."""
    return a.join(b, on=key, how="full")


def distinct_ids(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Distinct ids (NULL excluded, as a unique-count would)."""
    return df.where(F.col(id_col).isNotNull()).select(id_col).distinct()


def count_distinct_ids(df: DataFrame, id_col: str = ID) -> DataFrame:
    return df.agg(F.countDistinct(id_col).alias("n_distinct"))
