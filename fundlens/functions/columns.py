"""Column expressions (JVM-side, codegen'd) shared by the operators.

Null model: Spark keeps NULL and NaN apart; the library never emits NaN, so every
expression that can produce one (0/0, inf-inf, moments of inf) is wrapped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for a finite double; NULL stays NULL (so it never counts as finite)."""
    c = col_(c)
    return ~(F.isnan(c) | (c == F.lit(INF)) | (c == F.lit(-INF)))


def finite_or_null(c: str | Column) -> Column:
    """+-inf and NaN become NULL (rolling/expanding windows treat them as missing)."""
    c = col_(c)
    return F.when(is_finite(c), c)


def nan_to_null(c: str | Column) -> Column:
    c = col_(c)
    return F.when(~F.isnan(c), c)


def inf_to_null(c: str | Column) -> Column:
    """+-inf (and NaN) become NULL; the A6 rule applied to every aggregated column."""
    return finite_or_null(c)


def safe_divide(num: str | Column, den: str | Column, default=None) -> Column:
    """num / den; den == 0 gives ``default`` (NULL), NULL propagates. Never raises under ANSI."""
    num, den = col_(num), col_(den)
    out = F.when(den != 0, num.cast("double") / den.cast("double"))
    if default is not None:
        out = F.when(den == 0, F.lit(default)).otherwise(out)
    return out


def pct_change(cur: Column, prev: Column) -> Column:
    """cur/prev - 1 with the float rules of a vectorised division: x/0 is +-inf, 0/0 is NULL."""
    return (F.when(cur.isNull() | prev.isNull(), F.lit(None).cast("double"))
            .when(prev != 0, cur / prev - 1)
            .when(cur > 0, F.lit(INF))
            .when(cur < 0, F.lit(-INF)))


def adjusted_skew(c: str | Column) -> Column:
    """Bias-adjusted sample skewness G1 as an aggregate: n<3 -> NULL, zero variance -> 0."""
    c = col_(c)
    n = F.count(c)
    g1 = F.skewness(c)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise(nan_to_null(g1 * F.sqrt(n * (n - 1)) / (n - 2))))


def adjusted_kurt(c: str | Column) -> Column:
    """Bias-adjusted excess kurtosis G2 as an aggregate: n<4 -> NULL, zero variance -> 0."""
    c = col_(c)
    n = F.count(c)
    g2 = F.kurtosis(c)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise(nan_to_null((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))))


def stddev_samp(c: str | Column) -> Column:
    """Sample std (ddof=1); n=1 -> NULL; a NaN from infinite inputs -> NULL."""
    return nan_to_null(F.stddev_samp(col_(c)))


def digits_only(c: str | Column) -> Column:
    """Identifier normalisation: text form, trimmed, every non-digit removed; NULL -> ''."""
    c = col_(c)
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), r"\D", ""), F.lit(""))


def format_bytes(c: str | Column) -> Column:
    """Human-readable size with one decimal in 1024 steps (B, KB, MB, GB, TB, then PB)."""
    x = col_(c).cast("double")
    # fixed unit ladder
    units = ["B", "KB", "MB", "GB", "TB"]
    expr = None
    for i, u in enumerate(units):
        scaled = x / F.lit(1024.0 ** i)
        cond = scaled < 1024.0
        val = F.concat(F.regexp_replace(F.format_number(scaled, 1), ",", ""), F.lit(" " + u))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    pb = F.concat(F.regexp_replace(F.format_number(x / F.lit(1024.0 ** 5), 1), ",", ""), F.lit(" PB"))
    return expr.otherwise(pb)


def snake_case(name: str) -> str:
    """Header normaliser: strip, runs of space/dot/hyphen -> '_', lower, drop other characters,
    collapse and trim underscores. Accented letters are removed, not transliterated."""
    parts = ("".join(ch for ch in part if ch.isascii() and ch.isalnum()) for part in re.split(r"[\s._-]+", str(name).lower()))
    return "_".join(part for part in parts if part)


def round_doubles(df, digits: int = 6, cols: Iterable[str] | None = None):
    """Round every double column (for value hashing in oracle comparisons)."""
    from pyspark.sql.types import DoubleType, FloatType

    targets = set(cols) if cols is not None else None
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)) and (targets is None or f.name in targets):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
