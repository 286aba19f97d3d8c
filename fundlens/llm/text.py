"""Text expressions shared by the operators: exact word patterns, lower-casing of A-Z only, and
small helpers that keep an array expression evaluated once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"                              # what separates plain words
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"             # ASCII that is neither digit nor letter a-z
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separator: str = SPACE) -> Column:
    """Maximal runs outside ``separator``, in order."""
    return F.array_remove(F.split(text, separator), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` bound to a lambda variable, so it is evaluated once however
    often ``body`` uses it (also inside further lambdas)."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def pinned(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``df``'s columns ``keep`` plus the expressions ``made``, behind a generator: the optimizer
    can neither push a filter through it nor inline an expensive expression twice."""
    box = F.struct(*[v.alias(k) for k, v in made.items()])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(box)))


def grams(of: Column, k: int) -> Column:
    """64-bit hashes of every run of ``k`` consecutive elements; [] if there are fewer. ``of`` must
    be a column or a variable bound by ``let``."""
    n = F.size(of)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))),
                                      lambda i: F.xxhash64(F.slice(of, i, k)))
                  ).otherwise(F.array().cast("array<bigint>"))


def total(of: Column) -> Column:
    """Sum of an array of numbers as long."""
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that does not clash with ``df``'s (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
