"""Date splits.

Preferred form: one DataFrame with a ``dataset`` column, so the split-wise feature windows and
aggregates run as one plan with ``dataset`` as an extra partition key. A row dated on the second
cutoff belongs to *both* test and validation under the reference boundary; it is exploded into
both (no self-join).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import DATE

TRAIN, TEST, VALIDATION = "train", "test", "validation"


def _d(s: str):
    return F.to_date(F.lit(s.strip()))


def split_labeled(df: DataFrame, val_cutoff: str, train_test_cutoff: str, *, date_col: str = DATE,
                  boundary: str = "reference", out: str = "dataset") -> DataFrame:
    """train = date <= c1; test = c1 < date <= c2; validation = date >= c2 ("reference":
    c2 rows in test and validation) or date > c2 ("disjoint")."""
    c1, c2 = _d(train_test_cutoff), _d(val_cutoff)
    d = F.col(date_col)
    if boundary == "reference":
        val = d >= c2
    elif boundary == "disjoint":
        val = d > c2
    else:
        raise ValueError("boundary must be 'reference' or 'disjoint'")
    labels = F.array(F.when(d <= c1, F.lit(TRAIN)), F.when((d > c1) & (d <= c2), F.lit(TEST)),
                     F.when(val, F.lit(VALIDATION)))
    return df.withColumn(out, F.explode(F.filter(labels, lambda x: x.isNotNull())))


def _hash52(*cols) -> Column:
    """The first 13 hex digits of an md5 as a number (exact in a double)."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def split_random(df: DataFrame, val_cutoff: str, test_ratio: float = 0.2, seed: int = 42, *,
                 date_col: str = DATE, key_cols: list[str] | None = None,
                 out: str = "dataset") -> DataFrame:
    """validation = date >= cutoff; of the n rows before it exactly ceil(test_ratio * n) are test
    and the rest train. Rows are ranked by a seeded hash of the key, rows of equal hash by a hash of
    the whole row, and equal rows, which no choice can tell apart, are divided by count. The cut
    values are found by exact selection, so the data is not sorted."""
    from .quantiles import kth_smallest

    c2 = _d(val_cutoff)
    is_val = F.coalesce(F.col(date_col) >= c2, F.lit(False))
    first = _hash52(F.lit(str(seed)), *[F.col(c) for c in key_cols or df.columns])
    second = _hash52(F.lit(f"{seed}+"), *[F.col(c) for c in df.columns])
    pre = df.where(F.col(date_col) < c2).select(first.alias("__h1"), second.alias("__h2"))
    n = pre.count()
    if n == 0:
        raise ValueError(f"no row lies before {val_cutoff}: there is nothing to divide into train and test")
    n_test = int(math.ceil(test_ratio * n))
    label = F.when(is_val, F.lit(VALIDATION))
    if n_test == 0:
        return df.withColumn(out, label.otherwise(F.lit(TRAIN)))
    cut1 = kth_smallest(pre, "__h1", n_test - 1)
    below = pre.where(F.col("__h1") < cut1).count()
    tied = pre.where(F.col("__h1") == cut1)
    cut2 = kth_smallest(tied, "__h2", n_test - below - 1)
    below += tied.where(F.col("__h2") < cut2).count()
    last = tied.where(F.col("__h2") == cut2).count()
    room = n_test - below                                  # of the ``last`` equal rows at the cut
    at_cut = ~is_val & (first == cut1) & (second == cut2)
    label = label.when((first < cut1) | ((first == cut1) & (second <= cut2)), F.lit(TEST)).otherwise(F.lit(TRAIN))
    if room == last:
        return df.withColumn(out, label)
    equal = df.where(at_cut).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    divided = (equal.select(*df.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i"))
               .select(*df.columns, F.when(F.col("__i") <= room, F.lit(TEST)).otherwise(F.lit(TRAIN)).alias(out)))
    return df.where(F.coalesce(~at_cut, F.lit(True))).withColumn(out, label).unionByName(divided)
